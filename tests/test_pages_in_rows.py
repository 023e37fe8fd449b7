"""Pages of few visuals (J7, J8): one grid cell, and the greedy rule walked in the page's row, as on larger pages."""

import random

from pyspark.sql import functions as F

from fleetcat.operators import crowded, layout
from fleetcat.sources.fixtures import catalog


def _visuals(spark, sizes):
    rng = random.Random(3)
    rows = []
    for page, n in enumerate(sizes):
        for pos in range(1, n + 1):
            w, h = rng.choice([0.0, 40.0, 300.0, 1280.0]), rng.choice([30.0, 200.0, 720.0])
            rows.append((page % 2, page, pos, rng.choice(["textbox", "actionButton", "card", None]), rng.choice([0.0, 100.0, 900.0]),
                         rng.choice([0.0, 50.0]), w, h, float(rng.randrange(3)), 1280.0, 720.0))
    rows.append((None, 1, 1, "textbox", 0.0, 0.0, 40.0, 30.0, 0.0, 1280.0, 720.0))
    return spark.createDataFrame(rows, "model_id long, page_id long, pos long, type string, x double, y double, width double, height double, z double, "
                                       "page_width double, page_height double")


def test_small_pages_are_walked_in_order(spark):
    v = _visuals(spark, [1, 2, 5, 9, 30, 64]).where("type is not null")
    want, kept = set(), {}
    for r in sorted(v.collect(), key=lambda r: (r.z, r.pos)):
        mine = kept.setdefault((r.model_id, r.page_id), [])
        size = r.width * r.height
        over = [k for k in mine if size > 0 and k.width * k.height > 0
                and max(0, min(k.x + k.width, r.x + r.width) - max(k.x, r.x)) * max(0, min(k.y + k.height, r.y + r.height) - max(k.y, r.y))
                >= 0.95 * min(size, k.width * k.height)]
        if r.model_id is not None and r.type in ("textbox", "actionButton") and over:
            want.add((r.page_id, r.pos))
        else:
            mine.append(r)
    for got in (layout.consolidate_layers(v), crowded.consolidate_crowded(v)):
        assert got.columns == [*v.columns, "absorbed"] and got.count() == v.count()
        assert want and {(r.page_id, r.pos) for r in got.where("absorbed").collect() if r.model_id is not None} == want


def test_pages_of_few_visuals_are_one_row_and_one_cell(spark):
    v = _visuals(spark, [4, 12, 70])
    keep = ("pos", "x", "y", "z")
    pages = layout.page_rows(v, lambda items: F.transform(items, lambda i: F.struct(*[i[c].alias(c) for c in keep])))
    assert sorted(r["n"] for r in pages.where("small").select(F.size("items").alias("n")).collect()) == [4, 12]
    assert pages.where("not small").select(F.sum(F.size("items"))).first()[0] == 71
    a = v.where("width * height > 0 and model_id is not null")
    pairs = {(r.page_id, r.pos_a, r.pos_b) for r in layout.overlap_pairs(a).collect()}
    rows, want = a.collect(), set()
    for p in rows:
        for q in rows:
            if p.page_id == q.page_id and (p.z, p.pos) < (q.z, q.pos) and min(p.x + p.width, q.x + q.width) > max(p.x, q.x) and min(p.y + p.height, q.y + q.height) > max(p.y, q.y):
                want.add((p.page_id, p.pos, q.pos))
    assert pairs == want


def test_visuals_meet_their_pages_without_another_shuffle(spark, sf_small):
    v = catalog(spark, sf_small, "cat_visuals")["cat_visuals"]
    plan = v.groupBy("model_id", "page_id", "pos").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
