"""Shape-preserving pseudonyms: a keyed permutation of a value's letters and digits, in JVM expressions.

The letters and digits of a value are dealt into two halves, every other one; each round shifts one half by a keyed digest of the
other (a Feistel network over digits and letters), so that with one key different values of one shape have different
pseudonyms, and one value has the same pseudonym wherever it occurs. Punctuation and blanks stay. Numbers with a check digit
get it solved, or spoilt, at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks as C

#: Rounds of the network; each half is shifted in every other one.
ROUNDS = 6
#: (first code point, size) of the ranges inside which a character moves.
_RANGES = ((0x30, 10), (0x41, 26), (0x61, 26), (0xFF10, 10))
#: What stands for a letter of any other script, and for itself.
OTHER, OTHER_TOO = "範", "例"

#: Beginnings that a kind needs to stay what it is, with what they become (None: they stay).
HEADS: dict[str, tuple[str, str | None]] = {
    "tw_id": (r"^[A-Z][12]", None), "tw_arc": (r"^[A-Z][A-D89]", None), "mobile": (r"^(?:\+?886[\s\-]?|0)9", None), "jp_phone": (r"^0", None), "iban": (r"^[A-Z]{2}\d{2}", None),
    "uk_ni": (r"^[A-Z]{2}", "AB"), "us_ssn": (r"^\d{3}", "900"), "jp_postcode": (r"^〒[^0-9０-９]*\d{3}", "〒000"),
}
#: Kinds whose pseudonyms stand in names and addresses that are kept free for documents.
RESERVED: dict[str, Callable[[Column, Column], Column]] = {
    "email": lambda value, n: F.concat(F.regexp_replace(F.substring_index(value, "@", 1), r"[^0-9A-Za-z._%+\-]", "x"), F.lit("@example.com")),
    "ip": lambda value, n: F.concat(F.lit("192.0.2."), (n % 254 + 1).cast("string")),
    "hostname": lambda value, n: F.concat(F.substring_index(value, ".", 1), F.lit(".example.com")),
    "mac": lambda value, n: F.concat(F.lit("00:00:5E:00:53:"), F.lpad(F.hex(n % 256), 2, "0")),
}


def characters(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _range(c: Column, pick: Callable[[int, int], int]) -> Column:
    """pick(first, size) of the range that a character moves in, null if it does not move."""
    n, out = F.ascii(c), F.lit(None).cast("int")
    for first, size in _RANGES:
        out = F.when(n.between(first, first + size - 1), pick(first, size)).otherwise(out)
    return out


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def _shift(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, (F.floor(i / 2) % 16 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def permuted(value: Column, key: str, name: Column) -> Column:
    """The value with its letters and digits permuted under the key; no value that has one stays as it is."""
    moving = F.filter(characters(value), lambda c: _range(c, lambda first, size: size).isNotNull())
    symbols = F.transform(moving, lambda c: F.struct(_range(c, lambda first, size: first).alias("f"), _range(c, lambda first, size: size).alias("n"), (F.ascii(c) - _range(c, lambda first, size: first)).alias("v")))
    start = F.struct(symbols.alias("s"), F.lit("").alias("d"))

    def step(a: Column, k: Column) -> Column:
        half = F.floor(k / 2).cast("int")
        still = F.array_join(F.transform(F.filter(a["s"], lambda x, i: i % 2 != half % 2), lambda x: (x["f"] + x["v"]).cast("string")), ",")
        told = F.struct(a["s"].alias("s"), _digest(F.lit(key), name, half.cast("string"), F.size(a["s"]).cast("string"), still).alias("d"))
        moved = F.transform(a["s"], lambda x, i: F.struct(x["f"].alias("f"), x["n"].alias("n"), F.when(i % 2 == half % 2, (x["v"] + _shift(a["d"], i)) % x["n"]).otherwise(x["v"]).alias("v")))
        return F.when(k % 2 == 0, told).otherwise(F.struct(moved.alias("s"), a["d"].alias("d")))

    done = F.aggregate(F.array(*map(F.lit, range(2 * ROUNDS))), start, step, lambda a: a["s"])
    # one in very many values would be its own pseudonym: its first character moves on
    other = lambda s: F.when(s == symbols, F.transform(s, lambda x, i: F.struct(x["f"].alias("f"), x["n"].alias("n"), F.when(i == 0, (x["v"] + 1) % x["n"]).otherwise(x["v"]).alias("v")))).otherwise(s)
    letters = F.transform(F.element_at(F.transform(F.array(done), other), 1), lambda x: F.when(x["f"] == 0xFF10, F.substring(F.lit("０１２３４５６７８９"), x["v"] + 1, F.lit(1))).otherwise(F.chr(x["f"] + x["v"])))
    merged = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"), letters.alias("l"))

    def put(a: Column, c: Column) -> Column:
        moves = _range(c, lambda first, size: size).isNotNull()
        foreign = F.when(c.rlike(r"\p{L}"), F.when(c == OTHER, OTHER_TOO).otherwise(OTHER)).when(c.rlike(r"\p{Nd}"), "0").otherwise(c)
        return F.struct(F.concat(a["out"], F.when(moves, F.try_element_at(a["l"], a["k"])).otherwise(foreign)).alias("out"), (a["k"] + moves.cast("int")).alias("k"), a["l"].alias("l"))

    return F.aggregate(characters(value), merged, put, lambda a: a["out"])


def _solved(s: Column, place: str, check: Callable[[Column], Column], valid: bool) -> Column:
    """s with the digit at a place (a pattern) for which the check holds, or does not."""
    tried = F.transform(F.array(*map(F.lit, range(10))), lambda d: F.regexp_replace(s, F.lit(place), d.cast("string")))
    return F.coalesce(F.try_element_at(F.filter(tried, check if valid else lambda x: ~check(x)), F.lit(1)), s)


def _iban(s: Column, valid: bool) -> Column:
    """s with the two check digits that its other characters ask for, or one more than these."""
    bare = F.upper(F.regexp_replace(s, r"\s", ""))
    moved = F.concat(F.substring(bare, 5, 40), F.left(bare, F.lit(2)), F.lit("00"))
    n = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(characters(moved), F.lit(0), lambda r, c: (r * F.when(n(c) > 9, 100).otherwise(10) + n(c)) % 97)
    digits = F.lpad(((98 - rest) if valid else (98 - rest) % 97 + 1).cast("string"), 2, "0")
    return F.concat(F.left(s, F.lit(2)), digits, F.substring(s, 5, 200))


_LAST = r"[0-9](?=[^0-9]*$)"
#: Numbers with a check digit: where it stands, and the check.
CHECKED: dict[str, tuple[str, Callable[[Column], Column]]] = {"cc": (_LAST, C.card), "tw_biz": (_LAST, C.tw_business), "tw_id": (_LAST, C.tw_id), "jp_mynumber": (_LAST, C.jp_personal), "jp_corp_no": (r"^[0-9]", C.jp_corporate)}


def fake(kind: Column, value: Column, key: str, valid: bool = True) -> Column:
    """The pseudonym of a value of a kind (a column of names, see operators.pii) under a secret key.

    It has the shape of the value: digits stay digits, small and capital letters such, other letters become one sign, all else stays
    where it is. E-mail addresses, hosts and addresses of machines become reserved ones. Numbers with a check digit pass their
    check, or with valid=False fail it. It is never the value itself, unless that has neither letter nor digit.
    Null values are null, empty ones empty.
    """
    head, constant = F.lit(""), F.lit(None).cast("string")
    for name, (pattern, new) in HEADS.items():
        head = F.when(kind == name, F.regexp_extract(value, pattern, 0)).otherwise(head)
        constant = F.when((kind == name) & (F.regexp_extract(value, pattern, 0) != ""), new).otherwise(constant)
    ascii_digits = F.when(kind.isin(*CHECKED), F.translate(value, "０１２３４５６７８９", "0123456789")).otherwise(value)
    out = F.concat(F.coalesce(constant, head), permuted(F.substring(ascii_digits, F.length(head) + 1, F.lit(1 << 30)), key, kind))
    n = F.conv(F.substring(_digest(F.lit(key), kind, value), 1, 8), 16, 10).cast("long")

    def finished(plain: Column) -> Column:
        final = plain
        for name, (place, check) in CHECKED.items():
            final = F.when(kind == name, _solved(plain, place, check, valid)).otherwise(final)
        final = F.when(kind == "iban", _iban(plain, valid)).otherwise(final)
        for name, made in RESERVED.items():
            final = F.when(kind == name, made(plain, n)).otherwise(final)
        return final

    # a variable of a lambda is computed once, however often it is used
    return F.when(value == "", value).otherwise(F.element_at(F.transform(F.array(out), finished), 1))


def pseudonyms(found: DataFrame, key: str, valid: bool = True) -> DataFrame:
    """found (kind, value, ...; see operators.pii.spans) with fake: one pseudonym for each different value, for pii.rewrite.

    Different values are far fewer than hits in texts of one source, and a pseudonym depends on nothing but the key: no shuffle is needed.
    """
    return found.withColumn("fake", fake(F.col("kind"), F.col("value"), key, valid))
