"""Crowded pages against the sequential rule and all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetcat.operators import crowded, layout

PAGE = ("model_id long, page_id long, pos long, type string, title string, x double, y double, "
        "width double, height double, z double, page_width double, page_height double")
TEXT = ("textbox", "text", "button", "actionButton")


def _table(spark, items):
    return spark.createDataFrame([(1, p, i + 1, t, "", x, y, w, h, z, 1280.0, 720.0) for p, i, t, x, y, w, h, z in items], PAGE)


def walk(items):
    """Absorbed (page, pos): the rule, element by element."""
    kept, gone = {}, set()
    for p, i, t, x, y, w, h, z in sorted(items, key=lambda e: (e[0], 0.0 if e[7] is None else e[7], e[1])):
        boxes = kept.setdefault(p, [])
        whole = None not in (x, y, w, h) and w > 0 and h > 0

        def covers(k):
            ix = min(x + w, k[0] + k[2]) - max(x, k[0])
            iy = min(y + h, k[1] + k[3]) - max(y, k[1])
            return ix > 0 and iy > 0 and ix * iy / min(w * h, k[2] * k[3]) >= 0.95

        if whole and t.lower() in layout.ABSORBABLE_TYPES and any(covers(k) for k in boxes):
            gone.add((p, i + 1))
        elif whole:
            boxes.append((x, y, w, h))
    return gone


def _absorbed(df):
    return set(rows(df.where("absorbed"), "page_id", "pos"))


@pytest.mark.parametrize("load", [1, 64])
def test_random_pages_equal_the_walk(spark, monkeypatch, load):
    monkeypatch.setattr(crowded, "CELL_LOAD", load)
    rng = random.Random(load)
    items = []
    for p in range(6):
        for i in range(150):
            t = rng.choice([*TEXT, "card", "shape"])
            near = rng.random() < 0.5
            w, h = (100 + rng.randint(-3, 3), 50 + rng.randint(-2, 2)) if near else (rng.randint(0, 900), rng.randint(0, 500))
            x, y = (rng.choice((50, 640, 1250)) + rng.randint(-4, 4), rng.choice((50, 700)) + rng.randint(-3, 3)) if near else (rng.randint(-50, 1300), rng.randint(-50, 740))
            items.append((p, i, t, float(x), float(y), float(w), float(h), float(rng.randint(0, 40))))
    v = _table(spark, items)
    got = crowded.consolidate_crowded(v)
    assert got.count() == len(items) and _absorbed(got) == walk(items)


def test_one_place_and_jittered_stacks(spark):
    rng = random.Random(3)
    items = [(1, i, TEXT[i % 4] if i else "card", 100.0, 100.0, 200.0, 80.0, float(i % 7)) for i in range(4000)]
    items += [(2, i, "textbox", 300 + rng.random() * 30, 200 + rng.random() * 20, 200 + rng.random(), 80 + rng.random(), rng.random()) for i in range(4000)]
    items += [(3, i, "button", float(i % 60) * 20, float(i // 60) * 10, 15.0, 8.0, 0.0) for i in range(4000)]
    got = crowded.consolidate_crowded(_table(spark, items))
    want = walk(items)
    assert _absorbed(got) == want and not [p for p, _ in want if p == 3]


def test_a_crowded_cell_splits(spark):
    boxes = spark.createDataFrame([(1, 1, i % 64, i // 64, 12) for i in range(1000)], "model_id long, page_id long, mid_x int, mid_y int, own int")
    tree = crowded.quadtree(boxes)
    assert tree.where("level = 0").first()["split"] is True
    centres = crowded._centre_cells(boxes, crowded.MAX_LEVEL).join(tree.where("not split").drop("split"), crowded.CELL)
    assert centres.count() == 1000  # one leaf per centre
    stacked = boxes.withColumn("own", F.lit(0))  # boxes of the page's size do not split it
    assert crowded.quadtree(stacked).count() == 1
    assert centres.groupBy(*crowded.CELL).count().agg(F.max("count")).first()[0] <= crowded.CELL_LOAD


def test_nulls_empty_and_no_area(spark):
    items = [(1, 0, "text", 0.0, 0.0, 10.0, 10.0, None), (1, 1, "text", 0.0, 0.0, 10.0, 10.0, 0.0), (1, 2, "text", None, 0.0, 10.0, 10.0, 0.0),
             (1, 3, "text", 0.0, 0.0, 0.0, 10.0, 5.0), (1, 4, "text", 0.0, 0.0, 10.0, None, 5.0)]
    assert _absorbed(crowded.consolidate_crowded(_table(spark, items))) == {(1, 2)}
    assert crowded.consolidate_crowded(_table(spark, [])).count() == 0


def test_class_pairs_hold_every_pair(spark):
    rng = random.Random(5)
    items = [(p, i, "card", float(rng.randint(0, 4)) * 40, 0.0, float(rng.choice((0, 60, 100))), 50.0, float(rng.randint(0, 3))) for p in (1, 2) for i in range(40)]
    v = _table(spark, items)
    pairs, members = crowded.overlap_classes(v)
    of = {(r["page_id"], r["pos"]): r["class_pos"] for r in members.collect()}
    classes = {(r["page_id"], r["class_a"], r["class_b"]): r["ioa"] for r in pairs.collect()}
    area = {(p, i + 1): w * h for p, i, t, x, y, w, h, z in items}
    ids = sorted(of)
    whole = set()
    for n, (p, a) in enumerate(ids):
        for q, b in ids[n + 1:]:
            c = tuple(sorted((of[p, a], of[q, b])))
            if p == q and ((c[0] == c[1] and area[p, a] > 0) or (p, *c) in classes):
                whole.add((p, a, b))
    listed = {(r["page_id"], *sorted((r["pos_a"], r["pos_b"]))) for r in layout.overlap_pairs(v).collect()}
    assert whole == listed and len(classes) < len(listed)
