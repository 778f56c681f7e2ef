"""Invoices and receipts: fixed-width codes, dates of two calendars, amounts, periods and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Places of an invoice code's fields (start from 1, length), its least length, and the buyer that means none.
QR_FIELDS = {"invoice_number": (1, 10), "date": (11, 7), "random_code": (18, 4), "amount_untaxed": (22, 8), "amount_total": (30, 8), "buyer_vat": (38, 8), "seller_vat": (46, 8)}
QR_LENGTH = 77
NO_BUYER = "00000000"


def roc_date(s: Column) -> Column:
    """A date written YYYMMDD in years since 1911; null if there is none."""
    parts = lambda i: F.regexp_extract(s, r"^(\d{3,4})(\d{2})(\d{2})$", i)
    year = F.when(parts(1) != "", parts(1).cast("int") + 1911)
    return F.try_to_timestamp(F.format_string("%04d-%s-%s", year, parts(2), parts(3)), F.lit("yyyy-MM-dd")).cast("date")


def any_date(s: Column) -> Column:
    """A date with - or / in it; years under 1911 are counted from 1911."""
    parts = lambda i: F.regexp_extract(F.trim(s), r"^(\d{2,4})[-/](\d{1,2})[-/](\d{1,2})$", i)
    year = F.when(parts(1) != "", parts(1).cast("int"))
    year = F.when(year < 1911, year + 1911).otherwise(year)
    return F.try_to_timestamp(F.format_string("%04d-%s-%s", year, F.lpad(parts(2), 2, "0"), F.lpad(parts(3), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def hex_amount(s: Column) -> Column:
    return F.when(s.rlike("^[0-9A-Fa-f]+$"), F.conv(s, 16, 10).cast("long"))


def amount(s: Column) -> Column:
    """A whole amount: commas are left out and fractions cut off; null if it is no number."""
    return F.replace(F.trim(s), F.lit(",")).try_cast("double").cast("long")


def first_integer(s: Column) -> Column:
    return F.replace(F.regexp_extract(s, r"-?\d[\d,]*", 0), F.lit(",")).try_cast("long")


def qr_fields(s: Column) -> dict[str, Column]:
    """The fields of an invoice code. Its number decides whether it is one; other bad fields are null."""
    at = lambda k: F.substring(s, *QR_FIELDS[k])
    vat = lambda k: F.when(at(k).rlike(r"^\d{8}$"), at(k))
    fields = {
        "invoice_number": at("invoice_number"), "date": roc_date(at("date")), "random_code": at("random_code"), "amount_untaxed": hex_amount(at("amount_untaxed")),
        "amount_total": hex_amount(at("amount_total")), "buyer_vat": F.nullif(vat("buyer_vat"), F.lit(NO_BUYER)), "seller_vat": vat("seller_vat"),
    }
    good = (F.length(s) >= QR_LENGTH) & at("invoice_number").rlike(r"^[A-Z]{2}\d{8}$")
    return {k: F.when(good, c) for k, c in fields.items()}


def qr_items(s: Column) -> Column:
    """Item names of a second code: those after six fields of a counted list that is not encrypted, or of name, count and
    price triples; null if it is neither."""
    parts = F.split(s, ":")
    n = F.size(parts)
    listed = F.filter(F.transform(F.slice(parts, 7, F.greatest(n - 6, F.lit(0))), lambda x: F.trim(x)), lambda p: (p != "") & ~p.startswith("**"))
    counted = F.element_at(parts, 1).rlike(r"^\*\*\d+$") & (n >= 7) & F.get(parts, F.lit(1)).rlike(r"^\d+$") & F.get(parts, F.lit(2)).isin("0", "1")
    rest = F.slice(parts, 2, F.greatest(n - 1, F.lit(0)))
    names = F.transform(F.filter(rest, lambda p, i: i % 3 == 0), lambda x: F.trim(x))
    numbers = F.filter(rest, lambda p, i: i % 3 != 0)
    triples = (F.element_at(parts, 1) == "**") & (n > 3) & ((n - 1) % 3 == 0) & F.forall(names, lambda p: p != "") & F.forall(numbers, lambda p: p.try_cast("double").isNotNull())
    return F.when(counted & (F.get(parts, F.lit(2)) == "1"), None).when(counted & (F.size(listed) > 0), listed).when(triples, names)


def period_of(day: Column) -> tuple[Column, Column, Column]:
    """(first day, last day, number) of the two months' period that the month before a day is in."""
    before = F.add_months(F.trunc(day, "month"), -1)
    number = F.ceil(F.month(before) / 2).cast("int")
    start = F.make_date(F.year(before), number * 2 - 1, F.lit(1))
    return start, F.last_day(F.add_months(start, 1)), number


def recent_periods(today: Column, n: int) -> Column:
    """The last n periods that have begun, newest first: (start, end, number, running), of this year and the two before."""
    every = F.flatten(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda back: F.transform(F.array(*map(F.lit, range(6, 0, -1))), lambda p: F.make_date(F.year(today) - back, p * 2 - 1, F.lit(1)))))
    begun = F.slice(F.filter(every, lambda d: d <= today), 1, n)
    end = lambda d: F.last_day(F.add_months(d, 1))
    return F.transform(begun, lambda d: F.struct(d.alias("start"), end(d).alias("end"), F.ceil(F.month(d) / 2).cast("int").alias("number"), (end(d) >= today).alias("running")))


def tax(total: Column, untaxed: Column) -> Column:
    """What of an amount is tax; null if either part is not known."""
    return total - untaxed


def date_format(day: Column, how: str) -> Column:
    """iso, slash, chinese, roc or roc_chinese."""
    y, m, d = F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd")
    roc = F.year(day) - 1911
    forms = {
        "slash": F.concat_ws("/", y, m, d), "chinese": F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日")), "roc": F.concat_ws("/", F.format_string("%03d", roc), m, d),
        "roc_chinese": F.concat(F.lit("民國"), roc.cast("string"), F.lit("年"), m, F.lit("月"), d, F.lit("日")),
    }
    return F.coalesce(forms.get(how, F.date_format(day, "yyyy-MM-dd")), F.lit("")) if how not in forms else F.when(day.isNull(), "").otherwise(forms[how])


def amount_format(n: Column, how: str) -> Column:
    """plain, comma or currency; null is empty."""
    comma = F.format_number(n, 0)
    return F.coalesce({"comma": comma, "currency": F.concat(F.lit("NT$ "), comma)}.get(how, n.cast("string")), F.lit(""))


def number_format(s: Column, how: str) -> Column:
    """An invoice number as it is, or with a dash or blank after its letters; other lengths stay."""
    sep = {"dash": "-", "space": " "}.get(how, "")
    return F.when(s.isNull(), "").when(F.length(s) != 10, s).otherwise(F.concat(F.substring(s, 1, 2), F.lit(sep), F.substring(s, 3, 8)))


def to_24h(half: Column, hour: Column, minute: Column) -> Column:
    h = hour.cast("int") % 12 + F.when(half.isin("下午", "PM", "pm"), 12).otherwise(0)
    return F.format_string("%02d:%02d", h, minute.cast("int"))


def relative_time(at: Column, now: Column) -> Column:
    """How long ago, and from a week on the date."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    ago = lambda unit, word: F.concat(F.floor(s / unit).cast("string"), F.lit(word))
    return F.when(s < 60, "剛剛").when(s < 3600, ago(60, " 分鐘前")).when(s < 86400, ago(3600, " 小時前")).when(s < 7 * 86400, ago(86400, " 天前")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def receipt_kind(text: Column) -> Column:
    """The first kind of which a keyword occurs."""
    # What tells receipts apart, in the order of the tests.
    kinds = (("thsrc", "高鐵|THSR"), ("uber_invoice", "Uber.*統一編號|Uber.*發票"), ("uber_trip", "Uber"), ("tra", "臺鐵|台鐵|臺灣鐵路|台灣鐵路"))
    out = F.lit("unknown")
    for kind, pattern in reversed(kinds):
        out = F.when(text.rlike("(?s)" + pattern), kind).otherwise(out)
    return out


def labelled(text: Column, label: str) -> Column:
    """What stands after 'label :' on its line; empty is null."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^\s*(?:{label})[ \t　]*[:：][ \t　]*(.*)$", 1)), F.lit(""))
