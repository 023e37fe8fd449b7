"""Page layout geometry: overlap pairs, layer consolidation, numbering.

Overlap (J7) is a spatial equi-join: each visual is exploded into the grid
cells it covers (a fixed K x K grid per page, indices clamped to the page, so
at most K*K cells per visual), the join key is (model, page, cell), and a
pair is kept only in the cell holding the top-left corner of its
intersection, so each overlapping pair appears exactly once and no
non-overlapping pair is enumerated page-wide.

Consolidation (J8) is the reference's greedy rule: in z order, a text or
button element covered (>= 0.95 of the smaller area) by an earlier element
that is itself kept gets absorbed.  Absorption by an always-kept element is
a plain semi-join; the chains among absorbable elements are resolved by
rounds of joins (a node is decided once all its covering predecessors are),
with the state checkpointed to the shared checkpoint folder every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcat.functions.text import fit_label, layer_of
from fleetcat.session import cut_lineage

# Fixed values that must equal the reference's rules.
COVER_THRESHOLD = 0.95
ABSORBABLE_TYPES = ("actionbutton", "button", "text", "textbox")
BADGE_TOLERANCE = 6
BADGE_STEP = 20
GRID = 8  # cells per page axis for the overlap join, at most (a tuning knob, not a semantic value)
CELL_BOXES = 16  # boxes of a page per cell of its grid (a tuning knob)
PAGE_LOAD = 64  # visuals of a page that is settled in one row (a tuning knob)

PAGE_KEYS = ["model_id", "page_id"]


def _cell(v: Column, size: Column, grid: Column | None = None) -> Column:
    last = F.lit(GRID - 1) if grid is None else grid - 1
    return F.least(F.greatest(F.floor(v / size), F.lit(0)), last).cast("int")


def _with_cells(v: DataFrame, grid: Column | None = None) -> DataFrame:
    cw = F.greatest(F.col("page_width"), F.lit(1.0)) / (F.lit(GRID) if grid is None else grid)
    ch = F.greatest(F.col("page_height"), F.lit(1.0)) / (F.lit(GRID) if grid is None else grid)
    return (v.withColumn("cw", cw).withColumn("ch", ch)
            .withColumn("cx", F.explode(F.sequence(_cell(F.col("x"), cw, grid), _cell(F.col("x") + F.col("width"), cw, grid))))
            .withColumn("cy", F.explode(F.sequence(_cell(F.col("y"), ch, grid), _cell(F.col("y") + F.col("height"), ch, grid)))))


def overlap_pairs(visuals: DataFrame) -> DataFrame:
    """(model_id, page_id, pos_a, pos_b, ioa) for pairs with a positive intersection; a precedes b in z order.

    Input: visuals with x, y, width, height, z, pos and page_width/page_height.
    ioa = intersection area / smaller area (0 when the smaller area is 0, so
    such pairs are not listed).  The grid follows the page's load: a page of
    few visuals is one cell, so a large visual is not copied to 64.
    """
    cols = ["model_id", "page_id", "pos", "z", "x", "y", "width", "height", "page_width", "page_height"]
    page = Window.partitionBy(*PAGE_KEYS)
    load = F.count(F.lit(1)).over(page)
    # where a coordinate is missing the cells decide what meets, so such a page keeps the finest grid
    missing = F.max(F.array_contains(F.array(*[F.col(c).isNull() for c in cols[4:]]), True)).over(page)
    grid = F.when(missing, F.lit(GRID)).otherwise(F.least(F.ceil(F.sqrt(load / CELL_BOXES)), F.lit(GRID))).cast("int")
    cells = _with_cells(visuals.select(*cols, grid.alias("grid")), F.col("grid"))
    a = cells.select(*[F.col(c).alias(c if c in PAGE_KEYS else f"{c}_a") for c in cols], "cx", "cy", "cw", "ch", "grid")
    b = cells.select(*[F.col(c).alias(c if c in PAGE_KEYS else f"{c}_b") for c in cols], "cx", "cy")
    j = a.join(b, PAGE_KEYS + ["cx", "cy"])
    before = (F.col("z_a") < F.col("z_b")) | ((F.col("z_a") == F.col("z_b")) & (F.col("pos_a") < F.col("pos_b")))
    ix = F.greatest("x_a", "x_b")
    iy = F.greatest("y_a", "y_b")
    ix2 = F.least(F.col("x_a") + F.col("width_a"), F.col("x_b") + F.col("width_b"))
    iy2 = F.least(F.col("y_a") + F.col("height_a"), F.col("y_b") + F.col("height_b"))
    home = (F.col("cx") == _cell(ix, F.col("cw"), F.col("grid"))) & (F.col("cy") == _cell(iy, F.col("ch"), F.col("grid")))
    smaller = F.least(F.col("width_a") * F.col("height_a"), F.col("width_b") * F.col("height_b"))
    return (j.where(before & (ix2 > ix) & (iy2 > iy) & home & (smaller > 0))
            .select(*PAGE_KEYS, "pos_a", "pos_b", ((ix2 - ix) * (iy2 - iy) / smaller).alias("ioa")))


def cover_pairs(visuals: DataFrame) -> DataFrame:
    """(model_id, page_id, pos_a, pos_b, src_abs): a earlier element a and an absorbable later b that overlap by the threshold.

    At least 95 % of the smaller element lies in the larger one, so its centre
    does: the smaller side needs the one grid cell of its centre, the larger
    side all its cells.  Types travel with the pair.
    """
    v = visuals.select(*PAGE_KEYS, "pos", "z", "x", "y", "width", "height", "page_width", "page_height",
                       F.lower("type").isin(*ABSORBABLE_TYPES).alias("absorbable")).where("width * height > 0")
    v = v.withColumn("box", F.struct("pos", "z", "x", "y", "width", "height", "absorbable"))
    large = _with_cells(v).select(*PAGE_KEYS, "cx", "cy", F.col("box").alias("l"))
    cw = F.greatest(F.col("page_width"), F.lit(1.0)) / GRID
    ch = F.greatest(F.col("page_height"), F.lit(1.0)) / GRID
    small = v.select(*PAGE_KEYS, _cell(F.col("x") + F.col("width") / 2, cw).alias("cx"),
                     _cell(F.col("y") + F.col("height") / 2, ch).alias("cy"), F.col("box").alias("s"))
    j = large.join(small, [*PAGE_KEYS, "cx", "cy"])
    l, s = F.col("l"), F.col("s")
    ix = F.least(l["x"] + l["width"], s["x"] + s["width"]) - F.greatest(l["x"], s["x"])
    iy = F.least(l["y"] + l["height"], s["y"] + s["height"]) - F.greatest(l["y"], s["y"])
    area_l, area_s = l["width"] * l["height"], s["width"] * s["height"]
    covers = (area_s <= area_l) & (l["pos"] != s["pos"]) & (ix > 0) & (iy > 0) & (ix * iy / area_s >= COVER_THRESHOLD)
    large_first = (l["z"] < s["z"]) | ((l["z"] == s["z"]) & (l["pos"] < s["pos"]))
    first, then = F.when(large_first, l).otherwise(s), F.when(large_first, s).otherwise(l)
    return (j.where(covers).select(*PAGE_KEYS, first.alias("a"), then.alias("b")).where("b.absorbable")
            .select(*PAGE_KEYS, F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.col("a.absorbable").alias("src_abs")).distinct())


def page_rows(visuals: DataFrame, boxes) -> DataFrame:
    """Pages as rows, written: (page keys, items, boxes, small), items being the page's visuals.

    ``boxes(items)`` gives the elements that take part: structs of z, pos, x,
    y, width, height, absorbable.  ``small`` pages hold all their visuals, at
    most PAGE_LOAD, whose boxes can be put in order; the visuals of the others
    are dealt over rows of about that size.
    """
    load = F.count(F.lit(1)).over(Window.partitionBy(*PAGE_KEYS))
    share = F.when(F.col("_load") > PAGE_LOAD, F.pmod(F.xxhash64("pos"), F.ceil(F.col("_load") / PAGE_LOAD))).otherwise(0)
    rest = [c for c in visuals.columns if c not in PAGE_KEYS]
    pages = (visuals.withColumn("_load", load).withColumn("_share", share)
             .groupBy(*PAGE_KEYS, "_load", "_share").agg(F.collect_list(F.struct(*rest)).alias("items")))
    pages = pages.withColumn("boxes", boxes(F.col("items")))
    unordered = F.exists("boxes", lambda b: b["pos"].isNull() | b["z"].isNull() | b["x"].isNull() | b["y"].isNull())
    whole = F.col("model_id").isNotNull() & F.col("page_id").isNotNull() & (F.col("_load") <= PAGE_LOAD)
    return cut_lineage(pages.select(*PAGE_KEYS, "items", "boxes", (whole & ~unordered).alias("small")), "pages")


def flat_visuals(pages: DataFrame, columns, *more: Column) -> DataFrame:
    """The visuals of ``page_rows`` one by one, in their columns."""
    flat = pages.withColumn("_v", F.explode("items"))
    return flat.select(*[F.col(c) if c in PAGE_KEYS else F.col(f"_v.{c}").alias(c) for c in columns], *more)


def _covers(k: Column, o: Column) -> Column:
    ix = F.least(k["x"] + k["width"], o["x"] + o["width"]) - F.greatest(k["x"], o["x"])
    iy = F.least(k["y"] + k["height"], o["y"] + o["height"]) - F.greatest(k["y"], o["y"])
    smaller = F.least(k["width"] * k["height"], o["width"] * o["height"])
    return (k["pos"] != o["pos"]) & (ix > 0) & (iy > 0) & (ix * iy / smaller >= COVER_THRESHOLD)


def settle_pages(pages: DataFrame, columns) -> DataFrame:
    """The visuals of small pages with ``absorbed``: the greedy rule walked through the page's ordered boxes."""
    box = "struct<z: double, pos: bigint, x: double, y: double, width: double, height: double, absorbable: boolean>"
    none = F.struct(F.array().cast(f"array<{box}>").alias("kept"), F.array().cast("array<bigint>").alias("gone"))

    def step(at: Column, o: Column) -> Column:
        covered = o["absorbable"] & F.exists(at["kept"], lambda k: _covers(k, o))
        return F.when(covered, F.struct(at["kept"].alias("kept"), F.array_append(at["gone"], o["pos"]).alias("gone"))) \
            .otherwise(F.struct(F.array_append(at["kept"], o).alias("kept"), at["gone"].alias("gone")))

    boxes = F.array_sort(F.col("boxes").cast(f"array<{box}>"))  # by z, then pos
    walked = F.when(F.exists("boxes", lambda b: b["absorbable"]), F.aggregate(boxes, none, step)["gone"])
    gone = F.coalesce(F.array_contains("_gone", F.col("_v.pos").cast("long")), F.lit(False))
    return flat_visuals(pages.withColumn("_gone", walked), columns, gone.alias("absorbed"))


def consolidate_layers(visuals: DataFrame) -> DataFrame:
    """Visuals with ``absorbed`` (bool), by the greedy z-order rule.

    A page of at most PAGE_LOAD visuals is one row and walked there; on larger
    ones covers are joined by cell and chains settled in rounds.
    """
    def boxes(items):
        size = F.filter(items, lambda v: (v["width"] * v["height"] > 0) & v["type"].isNotNull())  # an element without a type covers nothing
        return F.transform(size, lambda v: F.struct(*[v[c].alias(c) for c in ("z", "pos", "x", "y", "width", "height")],
                                                    F.lower(v["type"]).isin(*ABSORBABLE_TYPES).alias("absorbable")))

    pages = page_rows(visuals, boxes)
    settled, larger = settle_pages(pages.where("small"), visuals.columns), pages.where("not small")
    return settled if larger.isEmpty() else settled.unionByName(_consolidate_in_rounds(flat_visuals(larger, visuals.columns)))


def _consolidate_in_rounds(visuals: DataFrame) -> DataFrame:
    """J8 for pages of any load.

    Rounds continue until every absorbable element is decided; each round
    decides at least the earliest undecided element of every chain, so the
    number of rounds is the longest chain of covering text/button elements.
    A round works on undecided elements only.
    """
    key = PAGE_KEYS + ["pos"]
    visuals = cut_lineage(visuals, "visuals")
    cover = cut_lineage(cover_pairs(visuals), "cover")
    by_fixed = cover.where(~F.col("src_abs")).select(*PAGE_KEYS, F.col("pos_b").alias("pos")).distinct()
    edges = cover.where("src_abs").join(by_fixed.withColumnRenamed("pos", "pos_a"), PAGE_KEYS + ["pos_a"], "left_anti") \
        .join(by_fixed.withColumnRenamed("pos", "pos_b"), PAGE_KEYS + ["pos_b"], "left_anti").select(*PAGE_KEYS, "pos_a", "pos_b")
    edges = cut_lineage(edges, "edges")
    absorbed = [by_fixed]
    while not edges.isEmpty():
        # undecided elements are the targets of the open edges; a source that is no target is kept
        targets = edges.select(*PAGE_KEYS, F.col("pos_b").alias("pos")).distinct()
        from_kept = edges.join(targets.withColumnRenamed("pos", "pos_a"), PAGE_KEYS + ["pos_a"], "left_anti")
        now = cut_lineage(from_kept.select(*PAGE_KEYS, F.col("pos_b").alias("pos")).distinct(), "absorbed")
        absorbed.append(now)
        # edges into absorbed elements are settled; absorbed elements cover nothing; kept sources are used up
        left = edges.join(now.withColumnRenamed("pos", "pos_b"), PAGE_KEYS + ["pos_b"], "left_anti") \
            .join(now.withColumnRenamed("pos", "pos_a"), PAGE_KEYS + ["pos_a"], "left_anti")
        edges = cut_lineage(left.select(*PAGE_KEYS, "pos_a", "pos_b"), "edges")
    gone = absorbed[0]
    for part in absorbed[1:]:
        gone = gone.unionByName(part)
    return (visuals.join(gone.withColumn("absorbed", F.lit(True)), key, "left")
            .withColumn("absorbed", F.coalesce("absorbed", F.lit(False))))


def wireframe(consolidated: DataFrame) -> DataFrame:
    """W1, W2 (+P17, P18) on the kept visuals: z-order number, badge offset, layer and label.

    W2: 1-based number by (z, input position) per page.  W1: the n-th visual
    in the same (round-half-even(x/6), round-half-even(y/6)) bucket gets an
    offset of 20*(n-1).  A page's visuals are one document's, so plain
    windows number them.
    """
    kept = (consolidated.where(~F.col("absorbed"))
            .withColumn("_bx", F.bround(F.col("x") / BADGE_TOLERANCE, 0))
            .withColumn("_by", F.bround(F.col("y") / BADGE_TOLERANCE, 0)))
    for keys, name in ((PAGE_KEYS, "z_number"), (PAGE_KEYS + ["_bx", "_by"], "_in_bucket")):
        kept = kept.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("z", "pos")))
    raw_label = F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.col("type")).otherwise(F.col("title"))
    layer = layer_of("type", "width", "height", "page_width", "page_height")
    return kept.select(
        *PAGE_KEYS, "pos", "z_number",
        ((F.col("_in_bucket") - 1) * BADGE_STEP).alias("badge_offset"),
        layer.alias("layer"),
        F.when(layer == "background", F.lit(None).cast("string")).otherwise(fit_label(raw_label, F.col("width"))).alias("label"))
