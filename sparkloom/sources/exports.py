"""Sinks: rows as CSV, JSON, XML, Markdown and text, with labels and formats of columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def resolved(order: Sequence[str], visible: Sequence[str], known: Sequence[str]) -> list[str]:
    """Columns to show: those of the order that are visible and known."""
    return [c for c in order if c in visible and c in known]


def shown(df: DataFrame, columns: Sequence[str], formats: Mapping[str, Callable[[Column], Column]] | None = None, labels: Mapping[str, str] | None = None) -> DataFrame:
    """The columns as text, each by its format and under its label; nulls are empty."""
    how = lambda c: (formats or {}).get(c, lambda x: x.cast("string"))(F.col(c))
    return df.select(*(F.coalesce(how(c), F.lit("")).alias((labels or {}).get(c, c)) for c in columns))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; cells that a spreadsheet would run are neutralised."""
    df.select(*(T.neutral_cell(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes)).write.option("header", True).option("escape", '"').csv(path)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def xml_lines(df: DataFrame, row: str = "row") -> DataFrame:
    cells = [F.concat(F.lit(f"<{c}>"), T.xml_text(F.col(c).cast("string")), F.lit(f"</{c}>")) for c in df.columns]
    return df.select(F.concat(F.lit(f"<{row}>"), *cells, F.lit(f"</{row}>")).alias("line"))


def markdown_lines(df: DataFrame) -> DataFrame:
    """Rows of a Markdown table; markdown_head has its first two lines."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(T.markdown_cell(F.col(c).cast("string")) for c in df.columns)), F.lit(" |")).alias("line"))


def markdown_head(columns: Sequence[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]


def text_lines(df: DataFrame, widths: Mapping[str, int]) -> DataFrame:
    """Columns side by side, filled to display widths."""
    return df.select(F.rtrim(F.concat_ws("  ", *(T.padded(F.coalesce(F.col(c).cast("string"), F.lit("")), w) for c, w in widths.items()))).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)


def bilingual_lines(pairs: DataFrame, form: str = "txt") -> DataFrame:
    """(doc, pos, line) of pairs (doc, pos, source, target): both texts and an empty line (txt), or a row of a Markdown table (md), whose head is markdown_head."""
    text = lambda c: F.coalesce(c, F.lit(""))
    if form == "md":
        cell = lambda c: F.replace(F.replace(text(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
        return pairs.select("doc", "pos", F.concat(F.lit("| "), cell("source"), F.lit(" | "), cell("target"), F.lit(" |")).alias("line"))
    tidy = lambda c: F.regexp_replace(text(c), r"(?U)\s+$", "")
    return pairs.select("doc", "pos", F.concat(tidy("source"), F.lit("\n"), tidy("target"), F.lit("\n")).alias("line"))


def block_lines(blocks: DataFrame, form: str = "txt") -> DataFrame:
    """(page, nth, line) of blocks (page, nth, kind, text; see operators.blocks.paragraphs): each with an empty line, headings with their marks in Markdown (md)."""
    marks = F.when(F.col("kind") > 0, F.concat(F.repeat(F.lit("#"), F.least(F.col("kind"), F.lit(6))), F.lit(" "))).otherwise("") if form == "md" else F.lit("")
    return blocks.select("page", "nth", F.concat(marks, "text", F.lit("\n")).alias("line"))


def annotation_lines(annots: DataFrame, form: str) -> DataFrame:
    """(doc, page, id, line) of annotations (doc, id, page, kind, author, subject, content): a review, a task, or JSON; csv rows are annotation_cells.

    A review quotes each line of the content; a task says the content, else the subject, else the kind.
    """
    has = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other if not isinstance(other, str) else F.lit(other))
    page = F.concat(F.lit("**第 "), F.col("page").cast("string"), F.lit(" 頁**"))
    if form == "json":
        line = F.to_json(F.struct("page", "kind", "author", "subject", "content"))
    elif form == "review":
        quoted = F.transform(T.split_lines(has("content", "(無內容)")), lambda x: F.concat(F.lit("  > "), x))
        line = F.concat(F.lit("- "), page, F.lit(" · "), F.col("kind"), F.lit(" · "), has("author", "(未署名)"), F.lit("\n"), F.array_join(quoted, "\n"), F.lit("\n"))
    else:
        body = has("content", has("subject", F.col("kind")))
        line = F.concat(F.lit("- [ ] "), page, F.lit(": "), body, F.lit(" _(來源:"), has("author", "?"), F.lit(" · "), F.col("kind"), F.lit(")_"))
    return annots.select("doc", "page", "id", line.alias("line"))


def annotation_cells(annots: DataFrame, tasks: bool = False) -> DataFrame:
    """Annotations, or the tasks that they are, as cells for write_csv."""
    has = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    if tasks:
        return annots.select(F.lit("[ ]").alias("status"), "page", has("content", has("subject", F.col("kind"))).alias("todo"), F.col("author").alias("assignee"), F.lit("").alias("priority"), F.col("kind").alias("type"), F.lit("").alias("notes"))
    return annots.select("page", F.col("kind").alias("type"), "author", "subject", "content")
