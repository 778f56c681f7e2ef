"""Labels, numerals, prefixes, replies and page lists, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import tw_business
from .unicode import folded, nfkc

#: Numerals of one digit.
NUMERALS = "一二三四五六七八九"


# Fixed value: marks that are a hyphen to a reader.
_DASHES = r"[\-－–—−‐‑‒―﹣]"


def label(s: Column) -> Column:
    """A form label's bare text: in NFKC form and one script, without white space, stars or numbering in front, colon or a bracket of ten characters behind, hyphens; lower case.

    A bracket that is all of the label stays.
    """
    out = F.regexp_replace(F.regexp_replace(nfkc(s), r"(?U)\s+", ""), r"^[*＊]+", "")
    out = F.regexp_replace(out, r"^(?:[(（]?[0-9]+[)）]?[.、．。)]|[(（]?[一二三四五六七八九十]+[)）、.])", "")
    out = F.regexp_replace(out, r"[:：]+$", "")
    bare = F.regexp_replace(out, r"[(（][^(（)）]{1,10}[)）]$", "")
    out = F.regexp_replace(F.when(bare != "", bare).otherwise(out), _DASHES, "")
    return folded(F.translate(out, "／", "/"))


def chinese_number(n: Column) -> Column:
    """Numerals of 1 to 9999."""
    digit = lambda d: F.substring(F.lit(NUMERALS), d.cast("int"), F.lit(1))
    out = F.lit("")
    for unit, name in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d = F.floor(n / unit) % 10
        gap = F.when((d == 0) & (n >= unit), "零").otherwise("") if unit > 1 else F.lit("")
        out = F.concat(out, F.when(d > 0, F.concat(digit(d), F.lit(name))).otherwise(gap))
    return F.regexp_replace(F.regexp_replace(out, "零+", "零"), "^零|零$", "")


def chinese_int(s: Column) -> Column:
    """The number that numerals up to thousands stand for; 0 if they are none."""
    shape = "^零*(?:([一二三四五六七八九]?)千)?零*(?:([一二三四五六七八九]?)百)?零*(?:([一二三四五六七八九]?)十)?零*([一二三四五六七八九]?)$"
    total = F.lit(0)
    for i, (unit, name) in enumerate(((1000, "千"), (100, "百"), (10, "十")), 1):
        d = F.regexp_extract(s, shape, i)
        total = total + F.when(s.contains(name), unit * F.when(d == "", 1).otherwise(F.position(d, F.lit(NUMERALS)))).otherwise(0)
    last = F.regexp_extract(s, shape, 4)
    total = total + F.when(last == "", 0).otherwise(F.position(last, F.lit(NUMERALS)))
    return F.when(s.rlike(shape) & (s != ""), total).otherwise(0).cast("int")


def in_range(option: Column, n: Column) -> Column:
    """Whether a number lies in an option such as 10以下, 11~50 or 201以上."""
    numbers = F.transform(F.regexp_extract_all(option, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    first, second = F.try_element_at(numbers, F.lit(1)), F.try_element_at(numbers, F.lit(2))
    hit = F.when(option.rlike("以下|以內|≤"), n <= first).when(option.rlike("以上|≥"), n >= first).otherwise(n.between(F.least(first, second), F.when(second.isNotNull(), F.greatest(first, second))))
    return F.coalesce(hit, F.lit(False))


def line_prefix(s: Column) -> tuple[Column, Column]:
    """(indent and bullet, number, quote or heading mark; the rest) of a line."""
    shape = r"^(\s*(?:(?:[-*+•]|#{1,6}|>+|\d{1,3}[.)、])\s+)?)(.*)$"
    return F.regexp_extract(s, shape, 1), F.regexp_extract(s, shape, 2)


def block_kind(text: Column, size: Column, bold: Column, median: Column) -> Column:
    """0 for a paragraph, 1 to 3 for a heading of that level, by the size of its letters against the median."""
    ratio = F.when(median > 0, size / median)
    return F.when(F.trim(text) == "", 0).when(ratio >= 1.6, 1).when(ratio >= 1.3, 2).when((ratio >= 1.15) & bold, 3).otherwise(0)


def echoes(reply: Column, marks: Sequence[str]) -> Column:
    """Whether a reply repeats a part of what it was asked with."""
    out = F.lit(False)
    for m in marks:
        out = out | reply.contains(m)
    return F.coalesce(out, F.lit(False))


def batch_reply(reply: Column, count: Column) -> Column:
    """Texts of the segments ⟦1⟧ to ⟦count⟧ of a reply, the last of each number; null unless it has these and no others."""
    shape = r"(?ms)^[ \t]*⟦(\d+)⟧(.*?)(?=^[ \t]*⟦\d+⟧|\z)"
    number, body = (F.regexp_extract_all(reply, F.lit(shape), F.lit(i)) for i in (1, 2))
    tidy = lambda b: F.array_join(F.filter(F.transform(F.split(b, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    found = F.zip_with(number, body, lambda n, b: F.struct(n.cast("int").alias("n"), tidy(b).alias("text")))
    wanted = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    same = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["n"]))) == wanted
    return F.when(same, F.transform(wanted, lambda i: F.element_at(F.filter(found, lambda x: x["n"] == i), -1)["text"]))


def _is_json(s: Column) -> Column:
    """Whether a text is one JSON value and nothing else: parsing stops after a value, so it must also be one inside of a list and of an object."""
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), s, F.lit("]"))), "$", "array<variant>")
    return F.coalesce((F.size(alone) == 1) & F.try_parse_json(F.concat(F.lit('{"k":'), s, F.lit("}"))).isNotNull(), F.lit(False))


def json_object(s: Column) -> Column:
    """The JSON of a free text: what is fenced if something is, as a whole, else from its first to its last brace; null if that is no JSON."""
    fenced = F.regexp_extract(s, r"```(?:json)?\s*([\s\S]+?)\s*```", 1)
    text = F.regexp_replace(F.when(fenced != "", fenced).otherwise(s), r"(?U)^\s+|\s+$", "")
    braces = F.regexp_extract(text, r"(\{[\s\S]+\})", 1)
    return F.when((text != "") & _is_json(text), text).when((braces != "") & _is_json(braces), braces)


def page_numbers(spec: Column) -> Column:
    """(first, last) of each part of '2,1,5-3'; null if a part is neither a number nor a range."""
    parts = F.filter(F.split(F.trim(spec), r"[,，;；\s]+"), lambda p: p != "")
    bounds = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("a"), F.regexp_extract(p, r"(\d+)$", 1).cast("int").alias("b")))
    return F.when(~F.exists(parts, lambda p: ~p.rlike(r"^\d+(\s*-\s*\d+)?$")), bounds)


def page_order(spec: Column, pages: Column) -> Column:
    """Pages in the order of a list whose ranges may run backwards; what lies outside is left out."""
    return F.filter(F.flatten(F.transform(page_numbers(spec), lambda r: F.sequence(r["a"], r["b"]))), lambda p: p.between(1, pages))


def pages_left(spec: Column, pages: Column) -> Column:
    """Pages, in order, that a list does not name."""
    return F.array_except(F.sequence(F.lit(1), pages), F.coalesce(page_order(spec, pages), F.array().cast("array<int>")))


def toc_entry(line: Column) -> tuple[Column, Column, Column]:
    """(title, level, page) of a line of a table of contents: two blanks of indent a level, leader dots left out; null without a page."""
    shape = r"^(\s*)(.*?)[\s.…·‧・]*?(\d+)\s*$"
    title = F.regexp_replace(F.trim(F.regexp_extract(line, shape, 2)), r"[\s.…·‧・]+$", "")
    page = F.when(title != "", F.nullif(F.regexp_extract(line, shape, 3), F.lit("")).try_cast("int"))
    return F.when(page.isNotNull(), title), F.when(page.isNotNull(), F.floor(F.length(F.regexp_extract(line, shape, 1)) / 2).cast("int") + 1), page


def tax_ids(text: Column) -> Column:
    """(value, valid) of the different numbers of eight digits in a text, and whether each passes the check of a business number."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![0-9])([0-9]{8})(?![0-9])"), F.lit(1)))
    return F.transform(found, lambda v: F.struct(v.alias("value"), tw_business(v).alias("valid")))


def amounts(text: Column, least: int = 10_000) -> Column:
    """Distinct whole numbers of at least so much, with or without thousands separators, in order of the text."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\d,.])(\d{1,3}(?:,\d{3})+|\d{5,15})(?![\d,])"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("long")), lambda v: v >= least))


def dates(text: Column) -> Column:
    """Distinct days of a text: western dates first, then those of the Republic's calendar; impossible ones are left out."""

    def found(shape: str, plus: int) -> Column:
        year, month, day = (F.transform(F.regexp_extract_all(text, F.lit(shape), F.lit(i)), lambda x: x.cast("int")) for i in (1, 2, 3))
        iso = F.zip_with(F.zip_with(year, month, lambda y, m: F.format_string("%04d-%02d-", y + plus, m)), day, lambda ym, d: F.concat(ym, F.lpad(d.cast("string"), 2, "0")))
        return F.transform(iso, lambda x: x.try_cast("date"))

    every = F.concat(found(r"(20\d{2})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})", 0), found(r"(?<!\d)(\d{2,3})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})", 1911))
    return F.array_distinct(F.filter(every, lambda d: d.isNotNull()))


def millimetres(x: Column, unit: str, dpi: int = 96) -> Column:
    """Millimetres as points or pixels."""
    return x * (72 / 25.4 if unit == "pt" else dpi / 25.4)


def iso_time(epoch: Column, offset_minutes: int) -> Column:
    """A time in seconds as ISO text of a fixed offset from UTC."""
    sign, m = "-" if offset_minutes < 0 else "+", abs(offset_minutes)
    local = F.timestamp_seconds(epoch + offset_minutes * 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"{sign}{m // 60:02d}:{m % 60:02d}"))


def epoch_of(local: Column, offset_minutes: int) -> Column:
    """Seconds of a local time 'yyyy-MM-ddTHH:mm'; an offset in the text counts, else the one given."""
    own = F.regexp_extract(local, r"([+-])(\d\d):?(\d\d)$", 1)
    minutes = F.regexp_extract(local, r"([+-])(\d\d):?(\d\d)$", 2).try_cast("int") * 60 + F.regexp_extract(local, r"([+-])(\d\d):?(\d\d)$", 3).try_cast("int")
    shift = F.when(own == "", offset_minutes).otherwise(F.when(own == "-", -minutes).otherwise(minutes))
    return F.unix_timestamp(F.try_to_timestamp(F.replace(F.left(local, F.lit(16)), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm"))) - shift * 60


def finding_key(category: Column, evidence: Column, title: Column, page: Column) -> Column:
    """Key of a finding that stays the same between versions: the category and what identifies it. evidence: a map of texts."""
    of = lambda k: F.coalesce(F.try_element_at(evidence, F.lit(k)), F.lit(""))
    mark = F.when(category.isin("tax-id-mismatch", "identity-mismatch"), of("actual")).when(category == "tax-id-invalid", of("tax_id")).when(category == "identity-outlier", of("outlier"))
    mark = mark.when(category == "duplicate-hash", F.left(of("sha256"), F.lit(16))).when(category == "template-residue", F.left(of("file_id"), F.lit(8))).when(category == "metadata-leak", F.array_join(F.array_sort(F.map_keys(evidence)), ","))
    return F.concat_ws(":", category, mark.otherwise(F.concat_ws(":", F.left(F.coalesce(title, F.lit("")), F.lit(50)), F.coalesce(page.cast("string"), F.lit("")))))


def trip_key(transport: Column, trip: Column, ticket: Column, *rest: Column) -> Column:
    """Key under which a journey is booked once: its number, else the ticket's, else all of what describes it."""
    have = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.concat(transport, F.lit("|trip:"), have(trip)), F.concat(transport, F.lit("|"), have(ticket)), F.concat_ws("|", transport, *(F.coalesce(c.cast("string"), F.lit("")) for c in rest)))


def station(name: Column) -> Column:
    """A station's place: without the line in front and the word for station behind."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "^高鐵", ""), "車?站$", ""))


def fingerprint(spans: Column, longest: int = 20, most: int = 60) -> Column:
    """Digest of the distinct short spans of a template, in order."""
    short = F.filter(F.transform(spans, F.trim), lambda s: F.length(s).between(1, longest))
    return F.sha2(F.array_join(F.slice(F.array_sort(F.array_distinct(short)), 1, most), "|"), 256)
