"""Checksums and masks of personal and business numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(r"\d"), F.lit(0)), lambda d: d.cast("int"))


def weighted(s: Column, weights: list[int], digit_sum: bool = False) -> Column:
    """Sum of digits times weights; with digit_sum of the digits of each product."""
    products = F.zip_with(digits(s), F.array(*map(F.lit, weights)), lambda a, b: a * b)
    if digit_sum:
        products = F.transform(products, lambda p: F.floor(p / 10).cast("int") + p % 10)
    return F.aggregate(products, F.lit(0), lambda a, b: a + b)


# Numbers of the letters of an identity card.
ID_LETTERS = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", (10, 11, 12, 13, 14, 15, 16, 17, 34, 18, 19, 20, 21, 22, 35, 23, 24, 25, 26, 27, 28, 29, 32, 30, 31, 33)))


def tw_id(s: Column) -> Column:
    """A letter, 1 or 2 and eight digits whose weighted sum is a multiple of ten."""
    number = F.element_at(F.create_map(*(F.lit(x) for kv in ID_LETTERS.items() for x in kv)), F.left(F.upper(s), F.lit(1)))
    whole = F.concat(number.cast("string"), F.substring(s, 2, 9))
    return F.coalesce(F.upper(s).rlike(r"^[A-Z][12]\d{8}$") & (weighted(whole, [1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1]) % 10 == 0), F.lit(False))


def tw_business(s: Column) -> Column:
    """Eight digits; the seventh may be a 7 that counts either way."""
    total = weighted(s, [1, 2, 1, 2, 1, 2, 4, 1], digit_sum=True)
    return F.coalesce(s.rlike(r"^\d{8}$") & ((total % 10 == 0) | ((F.substring(s, 7, 1) == "7") & ((total + 1) % 10 == 0))), F.lit(False))


def card(s: Column) -> Column:
    """13 to 19 digits with the Luhn check; blanks and hyphens do not count."""
    bare = F.regexp_replace(s, r"[\s\-]", "")
    return F.coalesce(bare.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", bare), F.lit(False))


def iban(s: Column) -> Column:
    """15 to 34 letters and digits with the remainder 1 by 97 once the first four go to the end."""
    bare = F.upper(F.regexp_replace(s, r"\s", ""))
    moved = F.concat(F.substring(bare, 5, 40), F.left(bare, F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.regexp_extract_all(moved, F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), lambda r, c: (r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.coalesce(bare.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$") & (rest == 1), F.lit(False))


def jp_number(s: Column) -> Column:
    """Twelve digits, not all the same, with the check digit of weights 6 5 4 3 2 7 6 5 4 3 2 by 11."""
    rest = weighted(F.left(s, F.lit(11)), [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return F.coalesce(s.rlike(r"^\d{12}$") & ~s.rlike(r"^(\d)\1*$") & (F.right(s, F.lit(1)).cast("int") == F.when(rest <= 1, 0).otherwise(11 - rest)), F.lit(False))


def jp_company(s: Column) -> Column:
    """Thirteen digits, not all the same; the first is nine less the remainder by nine of the others, weighted 1 and 2 in turn."""
    bare = F.regexp_replace(s, r"\D", "")
    return F.coalesce(bare.rlike(r"^\d{13}$") & ~bare.rlike(r"^(\d)\1*$") & (F.left(bare, F.lit(1)).cast("int") == 9 - weighted(F.substring(bare, 2, 12), [2, 1] * 6) % 9), F.lit(False))


def tw_residence(s: Column) -> Column:
    """A letter, A to D or 8 or 9, and eight digits; there is no check digit here."""
    return F.coalesce(F.upper(s).rlike(r"^[A-Z][A-D89]\d{8}$"), F.lit(False))


def uk_insurance(s: Column) -> Column:
    """Nine characters without white space whose first two are a prefix in use."""
    bare = F.upper(F.regexp_replace(s, r"\s+", ""))
    return F.coalesce((F.length(bare) == 9) & ~F.left(bare, F.lit(2)).isin("BG", "GB", "NK", "KN", "TN", "NT", "ZZ"), F.lit(False))


def us_phone(s: Column) -> Column:
    """Ten digits after a leading 1, neither area nor exchange with a 0 or 1 in front."""
    bare = F.regexp_replace(F.regexp_replace(s, r"\D", ""), r"^1(?=\d{10}$)", "")
    return F.coalesce(bare.rlike(r"^[2-9]\d{2}[2-9]\d{6}$"), F.lit(False))


def bank_account(s: Column) -> Column:
    """Eight to twenty digits."""
    return F.coalesce(F.length(F.regexp_replace(s, r"\D", "")).between(8, 20), F.lit(False))


def _bare(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, "０１２３４５６７８９", "0123456789"), r"\D", "")


def jp_personal(s: Column) -> Column:
    """jp_number of the digits, however they are set apart."""
    return jp_number(_bare(s))


def jp_corporate(s: Column) -> Column:
    """Thirteen digits, not all the same; the first is nine less the remainder by nine of the others' sum, every other one twice."""
    bare = _bare(s)
    total = weighted(F.substring(bare, 2, 12), [2, 1] * 6)
    return F.coalesce(bare.rlike(r"^\d{13}$") & ~bare.rlike(r"^(\d)\1*$") & (F.left(bare, F.lit(1)).cast("int") == 9 - total % 9), F.lit(False))


def keep_edges(s: Column, head: int, tail: int) -> Column:
    """Stars for all but the ends; for all if it is too short."""
    n = F.length(s)
    inner = F.concat(F.left(s, F.lit(head)), F.repeat(F.lit("*"), F.greatest(n - head - tail, F.lit(0))), F.right(s, F.lit(tail)))
    return F.when(n <= head + tail, F.repeat(F.lit("*"), n)).otherwise(inner)


def mask_email(s: Column) -> Column:
    local, domain = F.substring_index(s, "@", 1), F.regexp_extract(s, "@(.*)$", 1)
    hidden = F.when(F.length(local) <= 2, F.repeat(F.lit("*"), F.length(local))).otherwise(F.concat(F.left(local, F.lit(2)), F.lit("***")))
    return F.when(s.contains("@"), F.concat(hidden, F.lit("@"), domain)).otherwise(keep_edges(s, 2, 2))


def mask_ip(s: Column) -> Column:
    return F.when(s.rlike(r"^[^.]*(\.[^.]*){3}$"), F.concat(F.substring_index(s, ".", 1), F.lit(".***.***.***"))).otherwise(keep_edges(s, 3, 0))


def mask_digits(s: Column, head: int, tail: int) -> Column:
    """Stars for the digits between the first and the last ones; other characters stay where they are."""
    n = F.size(F.regexp_extract_all(s, F.lit(r"\p{Nd}"), F.lit(0)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        number = c.rlike(r"\p{Nd}")
        hide = number & (a["i"] >= head) & (a["i"] < n - tail)
        return F.struct(F.concat(a["out"], F.when(hide, "*").otherwise(c)).alias("out"), (a["i"] + number.cast("int")).alias("i"))

    return F.aggregate(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), start, step, lambda a: a["out"])


def mask_card(s: Column) -> Column:
    return F.when(F.size(F.regexp_extract_all(s, F.lit(r"\p{Nd}"), F.lit(0))) < 8, keep_edges(s, 2, 2)).otherwise(mask_digits(s, 4, 4))


def mask_name(s: Column) -> Column:
    n = F.length(F.trim(s))
    t = F.trim(s)
    return F.when(n <= 1, "O").when(n == 2, F.concat(F.left(t, F.lit(1)), F.lit("O"))).otherwise(F.concat(F.left(t, F.lit(1)), F.repeat(F.lit("O"), n - 2), F.right(t, F.lit(1))))


def mask_address(s: Column) -> Column:
    """A fixed form for CJK addresses; stars of the same shape for others."""
    return F.when(s.rlike(r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ff00}-\x{ffef}]"), "OO市OO區OO路OOO號").otherwise(F.regexp_replace(s, r"[^\s,.\-#/]", "*"))
