"""What Spark has no expression for: Unicode's compatibility form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(s: Column) -> Column:
    """The NFKC form of short texts such as labels, an Arrow batch at a time; null stays null."""

    @F.pandas_udf("string")
    def fold(column: pd.Series) -> pd.Series:
        return column.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return fold(s)


# Characters of one word in two scripts, and the form they are compared in.
VARIANTS = {"內": "内", "臺": "台", "戶": "户", "來": "来", "會": "会", "發": "发", "電": "电", "號": "号", "業": "业", "產": "产", "廠": "厂", "幣": "币", "稅": "税", "於": "于", "務": "务"}


def folded(s: Column) -> Column:
    """Without white space, in one script, in small letters; of a text in NFKC form."""
    return F.lower(F.translate(F.regexp_replace(s, r"(?U)\s+", ""), "".join(VARIANTS), "".join(VARIANTS.values())))
