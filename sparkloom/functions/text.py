"""Text functions as column expressions: lines, character classes, counts, sentences, languages, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a line, what is CJK, a word, a number, a sentence and a paragraph.
LINE_SEP = r"\R|[\x1c-\x1e]"  # \R: CR LF, LF, VT, FF, CR, U+0085, U+2028 or U+2029; twice as fast as their class
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
EN_WORD = r"[A-Za-z][A-Za-z'-]*"
NUMBER = r"\d+(?:\.\d+)?"
SENTENCE_END = r"[。！？!?\.]+\s*|[\r\n]{2,}"
PARAGRAPH_END = r"\n\s*\n+"
# English words that frequency tables leave out.
STOPWORDS = """the a an and or but if then of to in on at for with by from as is are was were be been being have has had do
does did will would could should may might shall can this that these those it its i you he she we they them his her our
their not no so than such into out up down off over under about above below between through all any some more most other
same than too""".split()


def split_lines(text: Column) -> Column:
    """Lines of a text: a separator at its end opens no further line, and an empty text has none.

    The parts are the variable of a lambda, as a column that is named four times splits the text up to four times.
    """
    lines = F.transform(F.array(F.split(text, LINE_SEP)), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    return F.coalesce(F.get(lines, 0), F.array().cast("array<string>"))


def strip(s: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def blank(s: Column) -> Column:
    return ~s.rlike(r"(?U)\S")


def matches(s: Column, pattern: str) -> Column:
    """Number of matches of a pattern."""
    return F.size(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)))


def pieces(s: Column, pattern: str) -> Column:
    """Number of parts between matches that are not blank."""
    return F.size(F.filter(F.split(s, pattern), lambda x: ~blank(x)))


def char_classes(text: Column) -> dict[str, Column]:
    """Counts of disjoint classes that add up to the length: CJK, white space, digits, letters, marks, other."""
    left = text
    out = {}
    classes = {"cjk": f"[{CJK}]", "whitespace": r"(?U)\s", "digit": r"\p{Nd}", "en_letter": r"\p{L}", "punct": r"[\p{P}\p{S}]"}
    for name, pattern in classes.items():
        after = F.regexp_replace(left, pattern, "")
        out[name] = (F.length(left) - F.length(after)).cast("long")
        left = after
    out["other"] = F.length(left).cast("long")
    return out


def text_counts(text: Column) -> dict[str, Column]:
    """Characters, words, numbers, paragraphs, sentences and lines of a text."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, f"[{CJK}]", ""))
    words = matches(text, EN_WORD)
    return {
        "char_total": F.length(text).cast("long"), "char_no_ws": F.length(F.regexp_replace(text, r"(?U)\s", "")).cast("long"), "cjk_chars": cjk.cast("long"), "en_words": words.cast("long"),
        "numbers": matches(text, NUMBER).cast("long"), "word_total": (cjk + words).cast("long"), "paragraphs": pieces(text, PARAGRAPH_END).cast("long"), "sentences": pieces(text, SENTENCE_END).cast("long"),
        "lines": F.size(F.filter(split_lines(text), lambda x: ~blank(x))).cast("long"),
    }


def reading_tenths(cjk: Column, words: Column) -> Column:
    """Reading time in tenths of a minute (300 CJK characters or 200 words a minute), halves rounded up."""
    return F.floor((2 * cjk + 3 * words + 30) / F.lit(60)).cast("long")


def words(text: Column) -> Column:
    """Lower-case English words of two letters or more that are not in STOPWORDS."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(EN_WORD), F.lit(0)), F.lower), lambda w: (F.length(w) >= 2) & ~w.isin(sorted(set(STOPWORDS))))


def cjk_bigrams(text: Column) -> Column:
    """Adjacent pairs of CJK characters, overlapping ones included."""
    return F.regexp_extract_all(text, F.lit(f"(?=([{CJK}]{{2}}))"), F.lit(1))


def language(text: Column) -> Column:
    """zh if over three tenths of the letters of the first 2,000 characters are CJK, else en; auto without letters."""
    head = F.substring(text, 1, 2000)
    cjk = F.length(head) - F.length(F.regexp_replace(head, f"[{CJK}]", ""))
    latin = F.length(head) - F.length(F.regexp_replace(head, "[A-Za-z]", ""))
    return F.when(cjk + latin == 0, "auto").when(cjk > 0.3 * (cjk + latin), "zh").otherwise("en")


def sentences(text: Column) -> Column:
    """Sentences, stripped, blank ones left out: after an end mark and white space or before a capital or CJK, and at newlines."""
    parts = F.split(text, r"(?<=[.!?。！？])\s+|(?<=[.!?。！？])(?=[A-Z\x{4e00}-\x{9fff}])|\n+")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 0)


#: Fixed value: characters that make a sentence more than marks.
CONTENT = r"[0-9A-Za-z\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}\x{ff66}-\x{ff9f}]"


def merge_fragments(parts: Column) -> Column:
    """Sentences with those that are marks alone put to the end of the one before, once for each kind of last mark."""

    def add(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat_ws(" ", last, s)))
        return F.when(s.rlike(CONTENT), F.concat(out, F.array(s))).when(F.size(out) == 0, out).when(F.right(last, F.lit(1)) == F.right(s, F.lit(1)), out).otherwise(joined)

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def variants(s: Column) -> Column:
    """Spelling variants folded to one."""
    return F.translate(s, "臺", "台")


def tokenised(s: Column) -> Column:
    """CJK and kana as words of their own, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, f"([{CJK}\\x{{3040}}-\\x{{30ff}}])", " $1 "), r"\s+", " "))


def natural_key(s: Column) -> Column:
    """Sort key in which runs of digits count as numbers and come before letters."""
    runs = F.regexp_extract_all(F.lower(s), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda x: x.rlike("^[0-9]+$")
    # a number sorts by its length without leading zeros, then by its digits
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.transform(runs, lambda x: F.struct(F.when(digits(x), 0).otherwise(1).alias("kind"), F.when(digits(x), F.length(bare(x))).otherwise(0).alias("n"), F.when(digits(x), bare(x)).otherwise(x).alias("t")))


def display_width(s: Column) -> Column:
    """Columns on a terminal: wide East Asian characters take two."""
    wide = r"[\x{1100}-\x{115f}\x{2e80}-\x{303e}\x{3041}-\x{33ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{a000}-\x{a4cf}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{ff00}-\x{ff60}\x{ffe0}-\x{ffe6}]"
    return 2 * F.length(s) - F.length(F.regexp_replace(s, wide, ""))


def padded(s: Column, width: int) -> Column:
    """Filled with blanks to a display width."""
    return F.concat(s, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - display_width(s)).cast("int")))


def title_case(s: Column) -> Column:
    """Every letter after a character that is none is upper case, the others are lower case."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 1 << 30))))


def neutral_cell(s: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a quote in front; others stay."""
    return F.when(s.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def markdown_cell(s: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(s, F.lit("")), F.lit("|"), F.lit("\\|")), "\r?\n", " ")


def xml_text(s: Column) -> Column:
    out = F.coalesce(s, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def error_page(text: Column) -> Column:
    """The status of a reply that is the page of a failing proxy, else the empty text.

    The first 500 characters after white space are looked at, as a reply that is a page begins as one: an error's number
    beside its words, 5xx for words without a number, cf-error, and html-body for any other page.
    """
    head = F.lower(F.left(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+", ""), F.lit(500)))
    wrapped = head.rlike("^(<html|<!doctype|<head)") | F.left(head, F.lit(200)).contains("<title>")
    named = F.regexp_extract(head, r"(\b50[02-4]\b|\b40[0-9]\b)\s*(gateway|server error|timeout|unavailable|bad|forbidden|too many)", 1)
    number = F.regexp_extract(head, r"\b(50[02-4])\b", 1)
    words = head.rlike("gateway time-out|bad gateway|service unavailable")
    kind = F.when(named != "", named).when(words, F.when(number != "", number).otherwise("5xx"))
    return F.when(~wrapped, "").otherwise(kind.when(head.contains("cloudflare") & head.rlike("error|timeout"), "cf-error").otherwise("html-body"))


def no_translation(s: Column) -> Column:
    """Whether a line has nothing to translate: a fence, a rule, a bare link, a tag, a table rule or filler."""
    return s.rlike(r"^\s*(```.*|~~~.*|[-*_]{3,}|https?://\S+|</?[a-zA-Z][^>]*>|\|?[\s:|-]*-[\s:|-]*\|?|[\s.…·_-]*)\s*$")
