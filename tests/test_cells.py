"""Neighbours and findings of cells against nested loops over a page."""

import re

import numpy as np

from sparkloom.operators import cells, pii

SF = "/root/testdata/sf0.001"


def near(page):
    """{(id, side): other} by looking at all pairs."""
    out = {}
    for a in page:
        for side in ("right", "below"):
            best = None
            for b in page:
                if a["id"] == b["id"]:
                    continue
                ah, bh = max(1, a["y1"] - a["y0"]), max(1, b["y1"] - b["y0"])
                if side == "right":
                    gap = b["x0"] - a["x1"]
                    fits = min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]) > 0.5 * min(ah, bh) and -2 <= gap <= 300
                else:
                    gap = b["y0"] - a["y1"]
                    fits = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]) > 0.3 * min(a["x1"] - a["x0"], max(1, b["x1"] - b["x0"])) and 0 <= gap <= 1.6 * ah
                if fits:
                    best = min(best or (gap, b["id"]), (gap, b["id"]))
            if best:
                out[a["id"], side] = best[1]
    return out


def brute(rows, kinds):
    out, pages = {}, {}
    for r in rows:
        if (r["text"] or "").strip(" "):
            pages.setdefault(r["page"], []).append(r)
    for page, each in pages.items():
        text = {r["id"]: r["text"] for r in each}
        plain = lambda k, t: ((m, 1 if re.compile(k.pattern).groups and m.group(1) is not None else 0) for m in re.finditer(k.pattern, t, re.I if k.ignore_case else 0))
        for k in kinds:
            for i, t in text.items():
                for m, g in plain(k, t):
                    out[page, k.name, i, m.start(g), m.group(g)] = None
        for (i, _), j in sorted(near(each).items(), reverse=True):
            joined, n = text[i] + " " + text[j], len(text[i])
            for k in kinds:
                if re.compile(k.pattern).groups:
                    for m, g in plain(k, joined):
                        if m.start() < n < m.end() and m.group(g).strip(" ") not in cells.LABELS:
                            key = (page, k.name, j if m.start(g) > n else i, m.start(g) - (n + 1 if m.start(g) > n else 0), m.group(g))
                            if out.get(key, i) is not None:
                                out[key] = min(out.get(key, i), i)
    return out


def grid(n=300):
    rng = np.random.default_rng(3)
    words = ["Date of Birth:", "DOB", "1999-01-02", "銀行帳號", "代表人", "Contact Person:", "Sarah Connor", "", " ", None, "a@b.com", "Passport No.", "AB1234567"]
    rows = []
    for i in range(n):
        x, y = float(rng.integers(0, 12) * 40), float(rng.integers(0, 10) * 12)
        rows.append({"page": i % 4, "id": i, "x0": x, "y0": y, "x1": x + float(rng.integers(0, 60)), "y1": y + float(rng.integers(0, 14)), "text": words[int(rng.integers(0, len(words)))], "label_id": 1})
    rows.append({"page": 9, "id": 1000, "x0": -700.0, "y0": -3.0, "x1": 5000.0, "y1": 900.0, "text": "DOB", "label_id": 1})
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], "page long, id long, x0 double, y0 double, x1 double, y1 double, text string, label_id int")


#: Kinds whose checks accept what the tests hold.
KINDS = pii.chosen(["dob", "person_name", "email", "passport", "driver_license"])


def test_against_nested_loops(spark):
    rows = grid()
    got = {(r["page"], r["id"], r["side"]): r["other"] for r in cells.neighbours(frame(spark, rows)).collect()}
    assert got == {(p, i, s): o for p in {r["page"] for r in rows} for (i, s), o in near([r for r in rows if r["page"] == p]).items()}
    found = {(r["page"], r["kind"], r["id"], r["start"], r["value"]): r["label_id"] for r in cells.findings(frame(spark, rows), KINDS).collect()}
    assert found == brute(rows, KINDS) and any(v is not None for v in found.values())
    assert cells.findings(frame(spark, rows).limit(0), KINDS).count() == 0


def test_values_are_mapped_to_their_cells_and_labels_are_none(spark):
    at = lambda i, x, y, t: {"page": 1, "id": i, "x0": x, "y0": y, "x1": x + 80.0, "y1": y + 10, "text": t, "label_id": 0}
    rows = [at(1, 0.0, 0.0, "出生日期"), at(2, 100.0, 0.0, "1998-12-28"), at(3, 0.0, 30.0, "被告代表人"), at(4, 0.0, 44.0, "銀行帳號")]
    got = {(r["kind"], r["id"], r["value"], r["label_id"], r["start"], r["end"], r["masked"]) for r in cells.findings(frame(spark, rows), pii.chosen(["dob", "person_name"])).collect()}
    assert got == {("dob", 2, "1998-12-28", 1, 0, 10, "****-**-**")}


def test_query(spark):
    from sparkloom.plans import page_queries as Q

    rows = [r.asDict() for r in Q.cells(spark, SF).collect()]
    kinds = [k for k in pii.defaults() + pii.chosen(["person_name"])]
    got = {(r["page"], r["kind"], r["id"], r["start"], r["value"]): r["label_id"] for r in Q.cell_findings(spark, SF).collect()}
    want = brute(rows, kinds)
    free = {k.name for k in kinds if k.check is None}
    assert {k: v for k, v in got.items() if k[1] in free} == {k: v for k, v in want.items() if k[1] in free}
    assert {"dob", "person_name", "passport", "bank_account"} <= {k[1] for k, v in got.items() if v is not None}
