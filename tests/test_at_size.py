"""Plans and steps that have to stay as they are for large tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stocktide.operators import extract, match, pallet
from stocktide.plans import inventory, registry

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def steps(monkeypatch):
    """Plans of all that `match` stores on its way."""
    seen, keep = [], match.stored
    monkeypatch.setattr(match, "stored", lambda df, name: seen.append(plan_of(df)) or keep(df, name))
    return seen


def test_nearest_identifiers_broadcast_nothing(spark, steps):
    """Texts that deletions make are hundreds for each identifier, which the planner doesn't know: it would send them all through the driver."""
    digits = spark.range(3000).select(F.col("id"), F.col("id").alias("ord"), F.concat(F.lit("SP22"), F.translate(F.lpad(F.col("id").cast("string"), 4, "0"), "0123456789", "ABCDEGHKLM")).alias("sku"))
    near = [registry.nearest_sku_every(spark, SF), match.nearest_sku(digits.select(F.concat(F.lit("QQ"), "sku", F.lit("QQ")).alias("key")).limit(40), digits)]
    assert len(steps) > 8 and not [p for p in (*steps, *map(plan_of, near)) if "Broadcast" in p]


@pytest.mark.parametrize("query", [registry.rule_cascade, inventory.suggested_rules])
def test_matching_broadcasts_its_signature_plan_only(spark, steps, query):
    """Keys, names and rules grow with the catalogue; a signature plan has a row for every two sizes of a name."""
    plans = [*steps, plan_of(query(spark, SF))]
    assert max(p.count("BroadcastExchange") for p in plans) <= 2


def test_union_numbered_moves_no_long_texts(spark, monkeypatch):
    """What is written and shuffled for numbers has the rows' own fields only; texts are made from them afterwards."""
    widths, keep = [], extract.stored
    monkeypatch.setattr(extract, "stored", lambda df, name: widths.append(df.columns) or keep(df, name))
    got = inventory.union_numbered(spark, SF)
    assert widths == [["source", "row", "source_ref", "_at"]] and "Exchange" not in plan_of(got).split("sha2")[0].replace("BroadcastExchange", "")


def test_places_of_ranges_are_those_of_brute_force(spark):
    """Ranges that overlap, lie within others, start together or have no value, in several columns."""
    rng = random.Random(5)
    cells = {(f, r, c): (f"{f}{r}.{c}" if rng.random() < 0.8 else None) for f in "ab" for r in range(1, 60) for c in range(1, 5) if rng.random() < 0.7}
    merges = {(f, r, c, r + rng.randint(0, h), c + rng.randint(0, 2)) for f, h, n in (("a", 25, 40), ("b", 2, 12)) for r, c in [(rng.randint(1, 59), rng.randint(1, 4)) for _ in range(n)]}
    want = dict(cells)
    for f, r, c, r2, c2 in sorted(merges, key=lambda m: m[1:3]):
        if cells.get((f, r, c)) is not None:
            want |= {(f, i, j): cells[f, r, c] for i in range(r, r2 + 1) for j in range(c, c2 + 1)}
    sheet = spark.createDataFrame([(f, "s", r, c, v, "s") for (f, r, c), v in cells.items()], "file string, sheet string, row int, col int, value string, kind string")
    ranges = spark.createDataFrame([(f, "s", r, r2, c, c2) for f, r, c, r2, c2 in merges], "file string, sheet string, min_row int, max_row int, min_col int, max_col int")
    seen = extract.read_cells(sheet, ranges)
    got = {(r["file"], r["row"], r["col"]): r["value"] for r in seen.collect()}
    assert got == want and seen.count() == len(want)
    plan = plan_of(seen)
    assert plan.index("Generate explode") < plan.index("Exchange ")  # places are made after the last shuffle


def test_texts_and_identifiers_of_areas_are_those_of_brute_force(spark, monkeypatch):
    """Places between points, words on one spot, blank and CJK words, blocks with several areas; several groups for each page."""
    monkeypatch.setattr(pallet, "TOGETHER", 20)
    rng = random.Random(9)
    some = ["a", "（", "灰色", "b", " ", "c1", "✅", "XL"]
    words = [(rng.randint(1, 2), rng.choice(some) if rng.random() < 0.7 else f"{rng.randint(10, 99)}SU-22-{rng.randint(0, 9999):04d}", rng.randint(0, 1600) / 4, rng.randint(0, 1600) / 4) for _ in range(700)]
    found = [(rng.randint(1, 2), 1, 1, rng.randint(1, 90), rng.randint(0, 3000) / 4, float(t), float(t + rng.randint(0, 50))) for t in (rng.randint(0, 2000) / 4 for _ in range(120))]
    w = spark.createDataFrame(words, "page int, text string, x0 double, top double")
    blocks = spark.createDataFrame(found, "page int, section long, column int, block long, col_x0 double, blk_top double, blk_bottom double")
    plain = [(p, t.strip(), x, y) for p, t, x, y in words if t not in ("✅", "XL") and "SU-22" not in t]

    def reading(boxes):
        spots = {}
        for p, t, x, y in plain:
            if any(p == q and y1 <= y <= y2 and x1 <= x <= x2 for q, y1, y2, x1, x2 in boxes):
                at, o = (round(y), round(x)), (round(y / 6), x, y, t)
                spots[at] = min(o, spots.get(at, o))
        out = ""
        for *_, t in sorted(spots.values()):
            tight = out == "" or out[-1] in "（灰色" or t[:1] == "灰"
            out += t and (t if tight else " " + t)
        return out.replace("（", "(") if spots else None

    keys = {}
    for f in found:
        keys.setdefault(f[:4], []).append(f[4:])
    areas = spark.createDataFrame([(*f[:4], f[5], f[6] + 30, f[4], f[4] + 80) for f in found], "page int, section long, column int, block long, y_lo double, y_hi double, x_lo double, x_hi double")
    got = {tuple(r)[:4]: r["t"] for r in pallet.text_near(areas, w, ["page", "section", "column", "block"], "t").collect()}
    want = {k: reading([(k[0], t, b + 30, x, x + 80) for x, t, b in boxes]) for k, boxes in keys.items()}
    assert got == {k: t for k, t in want.items() if t is not None} and len(got) > 30

    def known(k, boxes):
        near = [(0 if t - 20 <= y <= b + 24 else 1, abs(y - (t + b) / 2), y, x, s) for q, s, x, y in words for x0, t, b in boxes if "SU-22" in s and q == k[0] and x0 - 400 <= x <= x0 + 40 and t - 40 <= y <= b + 40]
        if near:
            *_, y, x, sku = min(near)
        by_sku = near and reading([(k[0], y - 42, y + 12, x - 22, x + 90)])
        return sku if near else "", by_sku or reading([(k[0], t - 14, b + 14, x0 - 400, x0 - 40) for x0, t, b in boxes]) or ""

    seen = {tuple(r)[:4]: (r["sku"], r["name"]) for r in pallet.identified(blocks, w).collect()}
    assert seen == {k: known(k, boxes) for k, boxes in keys.items()}


def test_areas_and_their_words_are_never_shuffled(spark):
    """Pairs of areas and words are made and read within a task: no aggregate or exchange stands on them."""
    plan = plan_of(inventory.near_text(spark, SF))
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_texts_of_blocks_are_neither_stored_nor_shuffled(spark):
    """A block's text is far larger than its row: it is made where blocks meet words, last of all, and a repeated row has it again."""
    plan = plan_of(inventory.block_identity(spark, SF))
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Exchange" not in plan.split("FlatMapCoGroupsInArrow")[0] and not hasattr(pallet, "stored")
    words = spark.createDataFrame([(1, "192SU-22-4410", 100.0, 100.0), (1, "Web", 90.0, 90.0), (1, "Hoodie", 110.0, 90.0), (1, "bare", 20.0, 500.0), (None, "lost", 20.0, 500.0), (1, "lost", None, 500.0)], "page int, text string, x0 double, top double")
    blocks = spark.createDataFrame([(1, 1, 1, 1, 150.0, 90.0, 110.0)] * 2 + [(1, 1, 1, 2, 150.0, 490.0, 510.0), (1, 1, 1, 3, 150.0, 890.0, 910.0), (1, 1, 1, 4, None, 90.0, 110.0), (None, 1, 1, 5, 150.0, 490.0, 510.0)], "page int, section long, column int, block long, col_x0 double, blk_top double, blk_bottom double")
    got = sorted((r["block"], r["sku"], r["name"]) for r in pallet.identified(blocks, words).collect())
    assert got == [(1, "192SU-22-4410", "Web Hoodie")] * 2 + [(2, "", "bare"), (3, "", ""), (4, "", ""), (5, "", "")]


@pytest.mark.parametrize("grid", [1, 4])
def test_stretches_of_lines_read_as_words_do(grid):
    """Lines of few heights and of many, several words on one spot, blank and CJK words, areas of one key that meet; texts come some at a time."""
    rng = random.Random(grid)
    some = {"a": (0, 0), "bb": (0, 0), "(": (0, 1), "灰": (1, 1), "": (0, 0)}
    places = sorted({(rng.randrange(200 * grid) / grid, rng.randrange(120 * grid) / grid) for _ in range(3000)})
    words = [(y, x, float(round(y / 6)), t, bool(some[t][0]), bool(some[t][1])) for y, x in places for t in rng.choices(list(some), (50, 30, 3, 3, 1))]
    boxes = []
    for owner in range(400):
        y, x = rng.randrange(200), rng.randrange(120)
        for k in range(1 + owner % 3):
            lo, left = (y + 5 * k, x + 7 * k) if owner % 2 else (rng.randrange(200), rng.randrange(120))
            boxes.append((owner, lo + rng.choice((0, 0.25)), lo + rng.choice((1, 5, 30, 60)), left, left + rng.choice((3, 40, 200))))
    want = {}
    for owner in range(400):
        spots, own = {}, [b for b in boxes if b[0] == owner]
        for y, x, line, t, *_ in words:
            if any(lo <= y <= hi and left <= x <= right for o, lo, hi, left, right in own):
                at = round(y), round(x)
                spots[at] = min((line, x, y, t), spots.get(at, (line, x, y, t)))
        if spots:
            out, before = "", ""
            for *_, t in sorted(spots.values()):
                if t:
                    out += t if not before or some[before][1] or some[t][0] else " " + t
                    before = t
            want[owner] = out
    page = pallet.Words(pa.table(dict(zip(("y", "x", "line", "folded", "opens", "closes"), map(list, zip(*words))))))
    got = [(dict(zip(owners.tolist(), texts.to_pylist())), texts.nbytes) for owners, texts in page.read(*map(np.array, zip(*boxes)))]
    assert {k: t for texts, _ in got for k, t in texts.items()} == want and sum(len(texts) for texts, _ in got) == len(want)
    wide = np.zeros(3000)
    portions = [(len(owners), texts.nbytes) for owners, texts in page.read(np.arange(3000), wide, wide + 200, wide, wide + 120)]
    assert sum(n for n, _ in portions) == 3000 and max(size for _, size in portions) < 4 << 20 < sum(size for _, size in portions)


def test_batches_that_cut_a_group_know_its_words(spark):
    """Keys of a group come in several batches, of which the first has the page's words."""
    w = inventory._words(spark, SF)
    areas = inventory._areas(spark, SF)
    want = sorted(map(tuple, pallet.identified(areas, w).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, pallet.identified(areas, w).collect())) == want and len(want) == areas.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
