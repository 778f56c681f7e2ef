"""Receipts of trains, rides and fees: their kind, the parser of each, and a reason where nothing can be read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import invoices as I
from ..functions import labels as L

_HAN = r"[\x{4e00}-\x{9fff}]"
# How addresses begin that are not yet the address, and lines of a trip that are no place.
COUNTRY = r"(?i)^(?:Taiwan|TWN|TW|R\.?O\.?C\.?|台灣|臺灣)[,，\s]*"
POSTCODE = r"^[0-9]{3,6}[-\s]*"
NO_PLACE = r"^\s*(?:\$|NT\$|總計|款項|行程費用|車牌號碼|車行|Uber|由.+提供|[0-9.]+\s*公里|上午|下午|[0-9]{1,2}:[0-9]{2}|$)"
CLOCK = r"^(上午|下午)\s*([0-9]{1,2}):([0-9]{2})$"
# Kinds of trains and of tickets.
TRAINS = r"(?<!乘車)((?:自強|莒光|復興|普悠瑪|太魯閣|新自強|PP自強|EMU[0-9]*|區間快|區間)\s*(?:\([^)]*\))?)"
TICKETS = r"((?:全票|孩童|敬老|愛心|優待|團體|軍警)\s*(?:\([^)]*\))?)"


def _trim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value); a variable of a lambda is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _some(s: Column) -> Column:
    """Null for what is empty."""
    return _once(_trim(s), lambda t: F.nullif(t, F.lit("")))


def _first(s: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(s, "(?d)" + pattern, group)


def kind(text: Column) -> Column:
    """Kind of a receipt, null if it is none: the fee's invoice before the ride, the ride before trains, whose words rides have too."""
    ride = text.contains("Uber") | text.contains("優步")
    trip = text.contains("行程詳細資訊") | text.contains("行程費用") | text.contains("感謝您的搭乘") | text.contains("車行／車隊")
    fast = text.contains("高鐵") | F.lower(text).contains("thsrc")
    rail = text.contains("購票證明") | text.contains("車次") | text.contains("臺鐵") | text.contains("台鐵")
    return F.when(text.contains("電子發票證明聯") & ride, "uber_invoice").when(ride & trip, "uber_trip").when(fast, "thsrc").when(rail, "tra")


def clean_address(s: Column) -> Column:
    """An address without country and postcode in front, in any order and however often (four times at most), and with its city once."""

    def strip(a: Column, _: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(a, COUNTRY, ""), POSTCODE, ""), r"^[,， \t]+", "")

    out = F.aggregate(F.array(*map(F.lit, range(4))), _trim(F.coalesce(s, F.lit(""))), strip)
    both = rf"^([台臺])({_HAN}{{1,2}}[市縣])[台臺]\2"  # two ways to write one character
    one = lambda a: F.when(a.rlike(rf"^[台臺]{_HAN}{{1,2}}[市縣]"), F.regexp_replace(a, both, "$1$2")).otherwise(F.regexp_replace(a, rf"^({_HAN}{{2,3}}[市縣])\1", "$1"))
    return _trim(_once(out, one))


def is_place(line: Column) -> Column:
    """A line of a trip that can be a place, or the name of one: not an amount, a label, a distance or a time."""
    return _once(_trim(line), lambda t: (F.length(t) >= 3) & ~t.rlike(NO_PLACE))


def _day(s: Column, first: str, second: str | None = None, last: str = "") -> Column:
    """The first date in figures, with these marks after year, month and day, as yyyy-MM-dd."""
    p = f"([0-9]{{4}}){first}([0-9]{{1,2}}){second or first}([0-9]{{1,2}}){last}"
    part = lambda hit, i: _first(hit, p, i)
    return _once(_first(s, p, 0), lambda hit: F.when(hit != "", F.concat_ws("-", part(hit, 1), F.lpad(part(hit, 2), 2, "0"), F.lpad(part(hit, 3), 2, "0"))))


def _fields(**given: Column) -> Column:
    names = ("transport", "trip_id", "day", "depart_time", "arrive_time", "origin", "destination", "train", "ticket_type", "ticket_no", "buyer", "seller", "vehicle", "distance", "note")
    numbers = ("fare", "untaxed", "tax")
    none = F.lit(None)
    return F.struct(*(given.get(n, none).cast("string").alias(n) for n in names), *(given.get(n, none).cast("long").alias(n) for n in numbers))


def fast_train(text: Column) -> Column:
    of = lambda label: _trim(_first(text, rf"{label}\s*[:：]\s*(.*)"))
    ride = of("乘車日期")
    hour, minute = (_first(ride, r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\s+([0-9]{1,2}):([0-9]{2})", i) for i in (1, 2))
    place = lambda label: _some(L.station(of(label)))
    return _fields(
        transport=F.lit("高鐵"), day=_day(ride, "[-/]"), depart_time=F.when(hour != "", F.concat_ws(":", F.lpad(hour, 2, "0"), minute)), origin=place("起程站"), destination=place("到達站"), fare=I.first_integer(of("票價")),
        untaxed=I.first_integer(of("銷售額")), tax=I.first_integer(of("營業稅額")), ticket_no=F.coalesce(_some(of("卡號/票號")), _some(of("票號"))), buyer=_some(of("統一編號")),
    )


def train(text: Column) -> Column:
    days = F.regexp_extract_all(text, F.lit(r"([0-9]{4}/[0-9]{1,2}/[0-9]{1,2})"), F.lit(1))
    printed = _first(text, r"印製日期\s*\n?\s*([0-9]{4}/[0-9]{1,2}/[0-9]{1,2})")
    day = F.coalesce(F.try_element_at(F.filter(days, lambda d: d != printed), F.lit(1)), F.nullif(printed, F.lit("")))
    way = r"([0-9]{1,2}:[0-9]{2})\s*([^\s>＞]+)\s*[>＞]\s*([0-9]{1,2}:[0-9]{2})\s*([^\s\n]+)"
    at = [_some(_first(text, way, i)) for i in range(1, 5)]
    number = _first(text, r"([0-9]+)\s*車次")
    sort = F.concat_ws(" ", _some(F.regexp_replace(_first(text, TRAINS), r"\s+(?=\()", "")), F.when(number != "", F.concat(number, F.lit("車次"))))
    ticket = _some(F.regexp_replace(_first(text, TICKETS), r"\s+(?=\()", ""))
    return _fields(
        transport=F.lit("台鐵"), day=_day(day, "/"), depart_time=at[0], origin=at[1], arrive_time=at[2], destination=at[3], train=_some(sort), ticket_type=ticket, ticket_no=_some(_first(text, r"(?U)\b([A-Z][0-9]{10,})\b")),
        fare=I.first_integer(_first(text, r"([0-9][0-9,]*)\s*元")),
    )


def ride(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"), _trim)
    follows = lambda ls: F.zip_with(ls, F.slice(ls, 2, F.size(ls)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # a time is one of a stop if the line after it is a place; a time of ordering or payment stands before other lines
    clock = lambda a: F.when(F.replace(a, F.lit(" ")).rlike(CLOCK), F.replace(a, F.lit(" "))).otherwise(a)
    hour = lambda a: I.to_24h(F.regexp_extract(clock(a), CLOCK, 1), F.regexp_extract(clock(a), CLOCK, 2), F.regexp_extract(clock(a), CLOCK, 3))

    def stops(ls: Column) -> Column:
        head = F.transform(ls, lambda x: x.contains("行程詳細資訊") | x.contains("Trip details"))
        part = F.slice(ls, F.coalesce(F.nullif(F.array_position(head, True), F.lit(0)), F.lit(0)).cast("int") + 1, F.size(ls))
        found = F.filter(follows(part), lambda x: clock(x["a"]).rlike(CLOCK) & F.coalesce(is_place(x["b"]), F.lit(False)))
        return F.transform(found, lambda x: F.struct(hour(x["a"]).alias("t"), clean_address(x["b"]).alias("p")))

    def fields(ls: Column, at: Column) -> Column:
        total = F.try_element_at(F.filter(follows(ls), lambda x: x["a"].isin("總計", "Total") & x["b"].isNotNull()), F.lit(1))["b"]
        fare = F.coalesce(I.first_integer(total), I.first_integer(_first(text, r"\$\s*([0-9,]+(?:\.[0-9]+)?)")))
        first, last = F.try_element_at(at, F.lit(1)), F.when(F.size(at) > 1, F.element_at(at, -1))
        return _fields(
            transport=F.lit("Uber"), trip_id=_some(_first(text, r"riders\.uber\.com/trips/([0-9a-fA-F-]{16,40})")), day=F.coalesce(_day(text, r"\s*年\s*", r"\s*月\s*", r"\s*日"), _day(text, "[/-]")),
            depart_time=first["t"], origin=_some(first["p"]), arrive_time=last["t"], destination=_some(last["p"]), fare=fare, vehicle=_some(_first(text, r"車牌號碼[：:]\s*\n?\s*([A-Z0-9-]{5,10})")),
            distance=_some(_first(text, r"([0-9.]+)\s*公里")), note=_some(_first(text, r"車行／車隊[：:]?\s*\n?\s*(.+)")),
        )

    return _once(lines, lambda ls: _once(stops(ls), lambda at: fields(ls, at)))


def fee(text: Column) -> Column:
    number = F.coalesce(_some(_first(text, r"發票號碼[：:]\s*([A-Z]{2}-?[0-9]{8})")), _some(_first(text, r"(?U)\b([A-Z]{2}-[0-9]{8})\b")))
    party = lambda who: _some(_first(text, rf"{who}\s*[:：]\s*([0-9]{{8}})"))
    day = _some(_first(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})"))
    return _fields(transport=F.lit("Uber 處理費"), day=day, fare=I.first_integer(_first(text, r"總計\s*[:：]\s*([0-9][0-9,]*)")), ticket_no=F.replace(number, F.lit("-")), buyer=party("買方"), seller=party("賣方"), note=F.lit("Uber 處理費電子發票"))


_PARSERS = {"thsrc": fast_train, "tra": train, "uber_trip": ride, "uber_invoice": fee}


def parsed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with receipt (a struct of fields, null where there is none), kind and problem.

    What cannot be read keeps its row and says why in problem: it is no receipt of a known kind (null and empty texts too), or none of day,
    origin and fare was found. Missing fields are null.
    """
    given = docs.withColumn("kind", kind(F.col(text_col)))
    receipt = F.lit(None).cast(given.select(_fields()).schema[0].dataType)
    for name, parser in _PARSERS.items():
        receipt = F.when(F.col("kind") == name, parser(F.col(text_col))).otherwise(receipt)
    out = given.withColumn("receipt", receipt)
    empty = F.col("receipt.day").isNull() & F.col("receipt.origin").isNull() & (F.coalesce("receipt.fare", F.lit(0)) == 0)
    out = out.withColumn("problem", F.when(F.col("kind").isNull(), "unknown kind").when(empty, "no field found"))
    return out.withColumn("receipt", F.when(F.col("problem").isNull(), F.col("receipt")))
