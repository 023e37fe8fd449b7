"""Crowded pages (J7, J8): covers and overlaps of stacked visuals without listing all pairs.

Equal boxes of a page are one class.  In a class only the first element (by z,
then position) is open: a later text or button is absorbed by the first if that
is kept, and otherwise by what absorbs the first.  So 100,000 visuals in one
place are one box with members.

Different boxes meet in the cells of a quadtree per page.  A cell splits while
more than ``CELL_LOAD`` centres of boxes that are small beside it lie in it; a
box stays in the cell of its own size, so a stack does not split into cells that
each of its boxes touches.  Of a covering pair the smaller box's centre lies in
the larger one (its area is covered to 95 %), so a box has one cell as the
smaller and the cells it touches as the larger side.

The greedy rule runs in rounds of semi-joins, which stop at a row's first match
and give no pairs: open boxes that an earlier kept box covers are absorbed;
open boxes that no earlier open box covers are kept.  Each round settles at
least the earliest open box of a page; boxes with one centre that do not cover
each other differ by 5 % in shape, which bounds what a leaf holds unmatched.

Elements without an area, or with a null in their geometry, cover nothing and
stay; a null z is 0.  ``pos`` is unique within a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcat.operators.layout import ABSORBABLE_TYPES, COVER_THRESHOLD, PAGE_KEYS, flat_visuals, overlap_pairs, page_rows, settle_pages
from fleetcat.session import cut_lineage

CELL_LOAD = 64  # centres a cell holds before it splits (a tuning knob)
MAX_LEVEL = 12  # splits of a page side; a fuller cell of this size stays a leaf

BOX = ["x", "y", "width", "height"]
CELL = [*PAGE_KEYS, "level", "cx", "cy"]


def box_classes(visuals: DataFrame) -> DataFrame:
    """``visuals`` with ``class_pos``: the smallest pos of the page's elements with the same box (null-safe)."""
    return visuals.withColumn("class_pos", F.min("pos").over(Window.partitionBy(*PAGE_KEYS, *BOX)))


def overlap_classes(visuals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J7 without the pairs inside and between stacks: (pairs of classes, membership).

    Pairs: (page keys, class_a < class_b, ioa), one row per two different boxes
    that overlap; members of one class overlap each other wholly.  Membership:
    (page keys, pos, class_pos).  Both together hold every pair of
    ``overlap_pairs``.
    """
    members = box_classes(visuals)
    sizes = ["page_width", "page_height"]
    boxes = members.where("pos = class_pos").select(*PAGE_KEYS, F.col("class_pos").alias("pos"), F.lit(0.0).alias("z"), *BOX, *sizes)
    pairs = overlap_pairs(boxes).withColumnsRenamed({"pos_a": "class_a", "pos_b": "class_b"})
    return pairs, members.select(*PAGE_KEYS, "pos", "class_pos")


def _index(v: Column, size: Column) -> Column:
    """The finest cell index of a coordinate, clamped to the page; coarser ones drop low bits."""
    cells = 1 << MAX_LEVEL
    return F.least(F.greatest(F.floor(v / F.greatest(size, F.lit(1.0)) * cells), F.lit(0)), F.lit(cells - 1)).cast("int")


def _at(i: Column, level: Column) -> Column:
    return F.floor(i / F.pow(F.lit(2), F.lit(MAX_LEVEL) - level)).cast("int")


def _own_level(length: Column, size: Column) -> Column:
    """The deepest level at which a cell is at least half as long as the box."""
    return F.least(F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1.0)) / length)) + 1, F.lit(0)), F.lit(MAX_LEVEL)).cast("int")


def _centre_cells(boxes: DataFrame, levels: int) -> DataFrame:
    level = F.col("level")
    return (boxes.withColumn("level", F.explode(F.sequence(F.lit(0), F.least(F.lit(levels), "own"))))
            .withColumns({"cx": _at(F.col("mid_x"), level), "cy": _at(F.col("mid_y"), level)}))


def quadtree(boxes: DataFrame) -> DataFrame:
    """The occupied cells of every page's tree: (page keys, level, cx, cy, split), each below a split cell."""
    deeper = F.count(F.when(F.col("own") > F.col("level"), 1))
    loads = cut_lineage(_centre_cells(boxes, MAX_LEVEL).groupBy(*CELL).agg((deeper > CELL_LOAD).alias("split")), "loads")
    split = loads.where("split").select(
        *PAGE_KEYS, (F.col("level") + 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    below = loads.withColumns({"px": half("cx"), "py": half("cy")}).join(split, [*PAGE_KEYS, "level", "px", "py"], "left_semi")
    tree = loads.where("level = 0").unionByName(below.drop("px", "py"))
    return cut_lineage(tree.select(*CELL, "split"), "tree")


def _placed(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes as smaller side (one cell of their centre) and as larger side (the cells they touch), both written."""
    tree = quadtree(boxes)
    deepest = tree.agg(F.max("level")).first()[0] or 0  # one number
    chain = _centre_cells(boxes, deepest).join(tree, CELL)
    small = cut_lineage(chain.where(~F.col("split") | (F.col("level") == F.col("own"))).select(*CELL, "box"), "small")
    # from the root down: a box enters the occupied cells it touches, and their children where they are split
    reached = boxes.withColumns({"level": F.lit(0), "cx": F.lit(0), "cy": F.lit(0)})
    large = None
    for level in range(deepest + 1):
        met = cut_lineage(reached.join(tree.where(F.col("level") == level), CELL), "met")
        part = met.select(*CELL, "box")
        large = part if large is None else large.unionByName(part)
        two = lambda c, n: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(n)
        down = met.where("split").select(*[c for c in boxes.columns], "cy", two("cx", "nx")).select(*boxes.columns, "nx", two("cy", "ny"))
        deeper = F.lit(level + 1)
        reached = down.where((F.col("nx") >= _at(F.col("lo_x"), deeper)) & (F.col("nx") <= _at(F.col("hi_x"), deeper))
                             & (F.col("ny") >= _at(F.col("lo_y"), deeper)) & (F.col("ny") <= _at(F.col("hi_y"), deeper))
                             ).withColumn("level", deeper).withColumnsRenamed({"nx": "cx", "ny": "cy"})
    return small, large


def _meets(targets: DataFrame, sources: DataFrame, target_is_small: bool) -> DataFrame:
    """(page keys, pos) of targets that an earlier source covers; a semi-join, so no pair is listed."""
    s = sources.select(*[F.col(c).alias(f"s_{c}") for c in CELL], F.col("box").alias("s"))
    a, b = F.col("box"), F.col("s")
    l, r = (b, a) if target_is_small else (a, b)
    ix = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    iy = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    area_l, area_s = l["width"] * l["height"], r["width"] * r["height"]
    earlier = (b["z"] < a["z"]) | ((b["z"] == a["z"]) & (b["pos"] < a["pos"]))
    on = earlier & (area_s <= area_l) & (ix > 0) & (iy > 0) & (ix * iy / area_s >= COVER_THRESHOLD)
    for c in CELL:
        on = on & (F.col(c) == F.col(f"s_{c}"))
    return targets.join(s, on, "left_semi").select(*PAGE_KEYS, F.col("box.pos").alias("pos"))


def _covered(targets, sources) -> DataFrame:
    """Ids of boxes of ``targets`` with an earlier cover in ``sources``; both are (small, large) placements."""
    found = _meets(targets[0], sources[1], True).unionByName(_meets(targets[1], sources[0], False))
    return cut_lineage(found.distinct(), "covered")


def _of(placed, ids: DataFrame, how: str):
    key = [*PAGE_KEYS, "pos"]
    return tuple(cut_lineage(p.withColumn("pos", F.col("box.pos")).join(ids, key, how).drop("pos"), "open") for p in placed)


def consolidate_crowded(visuals: DataFrame) -> DataFrame:
    """J8 for pages of any load: ``visuals`` with ``absorbed``; equal to ``consolidate_layers``.

    A page that its tree would hold in one cell is one row and walked there.
    """
    def boxes(items):
        placed = F.filter(items, lambda v: (v["width"] > 0) & (v["height"] > 0) & v["x"].isNotNull() & v["y"].isNotNull())
        return F.transform(placed, lambda v: F.struct(F.coalesce(v["z"], F.lit(0.0)).alias("z"), *[v[c].alias(c) for c in ("pos", *BOX)],
                                                      F.coalesce(F.lower(v["type"]).isin(*ABSORBABLE_TYPES), F.lit(False)).alias("absorbable")))

    pages = page_rows(visuals, boxes)
    settled, larger = settle_pages(pages.where("small"), visuals.columns), pages.where("not small")
    return settled if larger.isEmpty() else settled.unionByName(_consolidate_by_tree(flat_visuals(larger, visuals.columns)))


def _consolidate_by_tree(visuals: DataFrame) -> DataFrame:
    key = [*PAGE_KEYS, "pos"]
    visuals = cut_lineage(visuals, "visuals")
    v = visuals.select(*key, F.coalesce("z", F.lit(0.0)).alias("z"), *BOX, "page_width", "page_height",
                       F.coalesce(F.lower("type").isin(*ABSORBABLE_TYPES), F.lit(False)).alias("absorbable")).where("width > 0 and height > 0 and x is not null and y is not null")
    order = F.struct("z", "pos")
    classes = v.groupBy(*PAGE_KEYS, *BOX).agg(F.min(order).alias("first"), F.min(F.when(~F.col("absorbable"), order)).alias("fixed"),
                                              F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"))
    classes = cut_lineage(classes, "classes")
    later = v.where("absorbable").join(classes.select(*PAGE_KEYS, *BOX, "first"), [*PAGE_KEYS, *BOX]).where(F.col("pos") != F.col("first.pos"))
    opened = classes.where("fixed is null or first <> fixed").withColumn("at", F.col("first")).withColumn("open", F.lit(True))
    fixed = classes.where("fixed is not null").withColumn("at", F.col("fixed")).withColumn("open", F.lit(False))
    x, y, w, h = (F.col(c) for c in BOX)
    pw, ph = F.col("page_width"), F.col("page_height")
    boxes = opened.unionByName(fixed).select(
        *PAGE_KEYS, _index(x + w / 2, pw).alias("mid_x"), _index(y + h / 2, ph).alias("mid_y"), _index(x, pw).alias("lo_x"), _index(x + w, pw).alias("hi_x"),
        _index(y, ph).alias("lo_y"), _index(y + h, ph).alias("hi_y"),
        F.least(_own_level(w, pw), _own_level(h, ph)).alias("own"), F.struct("at.z", "at.pos", *BOX, "open").alias("box"))
    placed = _placed(cut_lineage(boxes, "boxes"))
    is_open, kept = tuple(p.where("box.open") for p in placed), tuple(p.where("not box.open") for p in placed)
    absorbed = [later.select(*key)]
    while True:
        gone = _covered(is_open, kept)
        absorbed.append(gone)
        is_open = _of(is_open, gone, "left_anti")
        waiting = _covered(is_open, is_open)
        if waiting.isEmpty():
            break
        kept, is_open = _of(is_open, waiting, "left_anti"), _of(is_open, waiting, "left_semi")
    ids = absorbed[0]
    for part in absorbed[1:]:
        ids = ids.unionByName(part)
    return (visuals.join(ids.withColumn("absorbed", F.lit(True)), key, "left")
            .withColumn("absorbed", F.coalesce("absorbed", F.lit(False))))
