"""Spans of a page as lines, lines as blocks, and blocks as paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L

#: A block ends where the gap to the next line is wider than so many of the page's median line heights.
GAP = 0.8
#: Paragraphs whose sizes differ by less than this may be one.
SIZE = 0.5
# Ends of sentences, and beginnings that are lines of their own.
_END, _END_BLANK = r"[。！？：.!?]$", r"(?U)[。！？：.!?]\s*$"
_ITEM, _ITEM_BLOCK = r"(?U)^(?:[\-*•●◆‣▪▫◦▶►]|\d+[.)、])", r"(?U)^(?:[\-*•●◆]|\d+[.)、]|[A-Z][A-Z\s]+$)"
_CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"


def is_cjk(c: Column) -> Column:
    """One character of the CJK blocks, their marks and full-width forms."""
    return c.rlike(f"^{_CJK}$")


def joined(a: Column, b: Column) -> Column:
    """Two pieces of running text: without a blank where a CJK character is at the seam."""
    return F.when(is_cjk(F.right(a, F.lit(1))) | is_cjk(F.left(b, F.lit(1))), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def join_lines(lines: Column) -> Column:
    """Lines of a block as text: a line goes on in the next one unless it ends a sentence or the next one is an item of a list."""

    def add(out: Column, line: Column) -> Column:
        last = F.element_at(out, -1)
        apart = (F.size(out) == 0) | last.rlike(_END) | line.rlike(_ITEM)
        return F.when(apart, F.concat(out, F.array(line))).otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined(last, line))))

    return F.array_join(F.aggregate(lines, F.array().cast("array<string>"), add), "\n")


def lines_of(spans: DataFrame) -> DataFrame:
    """(page, line, x0, y0, x1, y1, text, size, bold): spans (page, id, x0, y0, x1, y1, text, size, bold) whose heights overlap are one line, its texts from left to right.

    A line begins where a span's middle is under all that stands above it (a running maximum). size is the mean of its spans, bold the
    share of bold ones. Spans with a null or blank text or a null coordinate are left out.
    """
    given = spans.filter(F.trim("text") != "").dropna(subset=["x0", "y0", "x1", "y1"])
    above = Window.partitionBy("page").orderBy("y0", "y1", "x0", "id")
    lowest = F.max("y1").over(above.rowsBetween(Window.unboundedPreceding, -1))
    new = (lowest.isNull() | ((F.col("y0") + F.col("y1")) / 2 >= lowest)).cast("int")
    numbered = given.withColumn("_new", new).withColumn("line", F.sum("_new").over(above.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    texts = F.array_sort(F.collect_list(F.struct("x0", "id", "text")))
    return numbered.groupBy("page", "line").agg(
        *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))), F.trim(F.array_join(F.transform(texts, lambda s: s["text"]), "")).alias("text"), F.avg("size").alias("size"), F.avg(F.col("bold").cast("int")).alias("bold")
    )  # the spans of one line


def blocks_of(lines: DataFrame, gap: float = GAP) -> DataFrame:
    """(page, block, text, size, bold): lines of a page that stand close together, joined; a block ends at a gap of over `gap` times the median height of the page's lines."""
    height = lines.groupBy("page").agg(F.median(F.col("y1") - F.col("y0")).alias("_h"))
    down = Window.partitionBy("page").orderBy("line")
    apart = F.col("y0") - F.lag("y1").over(down) > gap * F.col("_h")
    numbered = lines.join(height, "page").withColumn("_new", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("block", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"])
    return numbered.groupBy("page", "block").agg(join_lines(texts).alias("text"), F.avg("size").alias("size"), (F.avg("bold") > 0.5).alias("bold"))  # the lines of one block


def paragraphs(blocks: DataFrame, median: float | Column) -> DataFrame:
    """(page, nth, kind, text, size): blocks in order, those joined that are one paragraph; kind (0 for a paragraph, else the level of a heading) as of labels.block_kind, against the median size of the document.

    A paragraph goes on in the next block if that is one too, of about the size of the first, does not begin like an item or a title, and
    the text so far does not end a sentence.
    """
    median = median if isinstance(median, Column) else F.lit(float(median))
    kinds = blocks.withColumn("kind", L.block_kind(F.col("text"), F.coalesce("size", F.lit(0.0)), F.coalesce("bold", F.lit(False)), median))
    whole = kinds.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "text", "size"))).alias("b"))  # the blocks of one page
    item = lambda kind, text, size: F.struct(kind.alias("kind"), text.alias("text"), size.alias("size"))
    none = F.array().cast("array<struct<kind:int,text:string,size:double>>")

    def add(out: Column, b: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        goes_on = (b["kind"] == 0) & (last["kind"] == 0) & (F.abs(F.coalesce(last["size"], F.lit(0.0)) - F.coalesce(b["size"], F.lit(0.0))) < SIZE) & ~last["text"].rlike(_END_BLANK) & ~b["text"].rlike(_ITEM_BLOCK)
        more = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(item(last["kind"], joined(last["text"], b["text"]), last["size"])))
        return F.when((F.size(out) > 0) & F.coalesce(goes_on, F.lit(False)), more).otherwise(F.concat(out, F.array(item(b["kind"], b["text"], b["size"]))))

    return whole.select("page", F.posexplode(F.aggregate("b", none, add)).alias("nth", "x")).select("page", "nth", "x.kind", "x.text", "x.size")
