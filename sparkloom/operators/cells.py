"""Cells of a page: neighbours to the right and below, and personal data whose label stands in one cell and whose value in the next."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii

#: The widest gap to the right, and the widest gap below in heights of the cell.
GAP_X, GAP_Y = 300.0, 1.6
#: Cells meet in the squares of a grid that they touch.
SQUARE = 64.0

# Names of fields; a value that is one of them is the label of the next field.
LABELS = (
    "身分證字號", "居留證號", "護照號碼", "駕照號碼", "出生日期", "健保卡號", "手機號碼", "市話", "Email", "地址", "信用卡號", "銀行帳號", "銀行代碼", "銀行分行代碼", "帳戶名稱", "統一編號", "公司名稱", "電子發票號碼", "訂單 / 採購單號", "人名",
    "美國社會安全號碼 (SSN)", "美國社會安全號碼（標籤式）", "英國國民保險號碼 (NI)", "出生日期（英文月份）", "電話（北美）", "電話（英國）", "地址（美式）", "英國郵遞區號", "IBAN 國際帳號", "個人番號（日本）", "法人番號（日本）", "電話（日本）", "郵遞區號（日本）",
    "地址（日本）", "姓名（日本）", "駕照號碼（日本）", "健保證號（日本）", "IP 位址", "車牌", "車輛 VIN 碼", "GPS 座標", "航班號", "訂位代號 (PNR)", "主機名稱 (FQDN)", "MAC 位址", "AD / LDAP DN", "Windows 帳號 (DOMAIN\\user)", "UUID / GUID", "內網 URL",
    "URL（含公開域名）", "域名 / FQDN（含公開域名）", "本機路徑 (含使用者名)", "API token / 金鑰", "標籤式密碼 / 帳號 (password: xxx)", "帳號/密碼斜線組合 (admin/pass)", "SSH 公鑰 (ssh-rsa / ed25519 ...)", "PEM 區塊 (CERT / KEY / CSR)", "Hash 雜湊值 (MD5/SHA/bcrypt)",
)


def neighbours(cells: DataFrame, gap_x: float = GAP_X, gap_y: float = GAP_Y) -> DataFrame:
    """(page, id, side, other): for each cell (page, id, x0, y0, x1, y1) the nearest one to its right and the nearest one below.

    To the right: more than half of the lower one's height in common, beginning at most 2 before this one's end and at most
    gap_x after it. Below: more than three tenths of the narrower one's width in common, beginning at most gap_y of this one's
    heights under it. Heights and widths count as 1 at least where they divide. Of equal gaps the smaller id wins. Cells
    meet in the squares of a grid: a cell asks in those in which a neighbour can begin. Cells with a null coordinate have none.
    """
    given = cells.select("page", "id", "x0", "y0", "x1", "y1").dropna()
    square = lambda v: F.floor(v / SQUARE)
    span = lambda a, b: F.explode(F.sequence(square(a), F.greatest(square(a), square(b))))
    height = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))

    def met(asks: DataFrame, stands: DataFrame) -> DataFrame:
        other = stands.select("page", "gx", "gy", F.col("id").alias("other"), *(F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")))
        # cells come out of an explode, so the size of their file says little of them: a broadcast of one side would not fit the driver
        return asks.join(other.hint("merge"), ["page", "gx", "gy"]).filter("id <> other").withColumn("oh", F.greatest(F.lit(1.0), F.col("oy1") - F.col("oy0")))

    # to the right the other begins in one column of squares, and shares a row of squares; below it is the other way round
    begins_x = given.withColumn("gx", square(F.col("x0"))).withColumn("gy", span(F.col("y0"), F.col("y1")))
    right = met(given.withColumn("gx", span(F.col("x1") - 2, F.col("x1") + gap_x)).withColumn("gy", span(F.col("y0"), F.col("y1"))), begins_x)
    common_y = F.least("y1", "oy1") - F.greatest("y0", "oy0")
    right = right.withColumn("gap", F.col("ox0") - F.col("x1")).filter((common_y > 0.5 * F.least(height, F.col("oh"))) & (F.col("gap") >= -2) & (F.col("gap") <= gap_x))
    begins_y = given.withColumn("gy", square(F.col("y0"))).withColumn("gx", span(F.col("x0"), F.col("x1")))
    below = met(given.withColumn("gy", span(F.col("y1"), F.col("y1") + gap_y * height)).withColumn("gx", span(F.col("x0"), F.col("x1"))), begins_y)
    common_x = F.least("x1", "ox1") - F.greatest("x0", "ox0")
    narrow = F.least(F.col("x1") - F.col("x0"), F.greatest(F.lit(1.0), F.col("ox1") - F.col("ox0")))
    below = below.withColumn("gap", F.col("oy0") - F.col("y1")).filter((common_x > 0.3 * narrow) & (F.col("gap") >= 0) & (F.col("gap") <= gap_y * height))
    both = right.select("page", "id", F.lit("right").alias("side"), "gap", "other").unionByName(below.select("page", "id", F.lit("below").alias("side"), "gap", "other"))
    return both.groupBy("page", "id", "side").agg(F.min(F.struct("gap", "other"))["other"].alias("other"))


def findings(cells: DataFrame, kinds: Sequence[pii.Kind] | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """(page, kind, id, start, end, value, masked, label_id) of the personal data on each page; cells: (page, id, x0, y0, x1, y1, text).

    id is the cell in which the value begins, start and end its place in the text of that cell. label_id is null for what one cell
    has alone, else the cell with the label: kinds with a label are also searched in each cell and a neighbour joined by a
    blank, where the hit reaches over both and the value is no field's name. Null and blank texts are no cells. (page, id) names a
    cell; a finding that comes about in several ways counts once.
    """
    kinds = list(kinds or pii.KINDS)
    given = cells.filter(F.trim("text") != "").withColumn("cell", F.struct("page", "id"))
    alone = pii.hits(given.select("cell", "text"), kinds, "cell").select("cell", "kind", "start", "end", "value", "masked", F.lit(None).cast(cells.schema["id"].dataType).alias("label_id"))
    labelled = [k for k in kinds if re.compile(k.pattern).groups]
    texts = given.select("page", "id", "text")
    second = texts.select("page", F.col("id").alias("other"), F.col("text").alias("second"))
    pairs = neighbours(given).join(texts.hint("merge"), ["page", "id"]).join(second.hint("merge"), ["page", "other"])
    pairs = pairs.withColumn("cell", F.struct("page", "id", "other", F.length("text").alias("n"))).select("cell", F.concat_ws(" ", "text", "second").alias("text"))
    over = pii.hits(pairs, labelled, "cell") if labelled else None
    if over is not None:
        n = F.col("cell.n")
        over = over.filter((F.col("first") < n) & (F.col("last") > n) & ~F.trim("value").isin(*labels))
        inside = F.col("start") > n  # the value begins in the second cell
        at = lambda c: (F.when(inside, F.col(c) - n - 1).otherwise(F.col(c))).cast("int").alias(c)
        over = over.select(
            F.struct(F.col("cell.page").alias("page"), F.when(inside, F.col("cell.other")).otherwise(F.col("cell.id")).alias("id")).alias("cell"), "kind", at("start"), at("end"), "value", "masked", F.col("cell.id").alias("label_id")
        )
        alone = alone.unionByName(over)
    # null, what one cell has alone, comes before the others
    once = alone.groupBy("cell", "kind", "start", "value").agg(F.min(F.struct(F.coalesce(F.col("label_id").isNotNull(), F.lit(False)).alias("late"), "label_id", "end", "masked")).alias("f"))
    return once.select("cell.page", "kind", "cell.id", "start", "f.end", "value", "f.masked", "f.label_id")
