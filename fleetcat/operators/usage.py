"""Where measures are used on report pages.

J1 is an equi-join on (model_id, cleaned field name).  J2 is the reference's
substring test ("the measure name occurs inside some bound field"); instead of
a nested loop over names x fields we enumerate, for every distinct field, its
substrings of exactly the lengths that measure names of that model have, and
semi-join them to the names.  That is exact, linear in field length, and every
shuffle is keyed by (model_id, substring).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcat.functions import escape_html, is_measure_field, is_system_table, visual_label
from fleetcat.functions.names import well_label, well_of, with_clean_field_name

UNUSED_LISTED = 10
MORE_SUFFIX = " … and {n} more"
FIELD_SHARES = 16  # shares that a model's fields are dealt into (a tuning knob)


def visual_description(vtype, title) -> F.Column:
    """Readable label of the visual type plus its title in quotes (escaped), as in usage lists."""
    t = F.coalesce(F.col(title), F.lit(""))
    return F.concat(visual_label(F.col(vtype)),
                    F.when(t != "", F.concat(F.lit(' "'), escape_html(t), F.lit('"'))).otherwise(F.lit("")))


def visuals_with_page(visuals: DataFrame, pages: DataFrame) -> DataFrame:
    """Attach page attributes; visuals of unknown pages drop."""
    return visuals.join(pages.select("model_id", "page_id", "page_name",
                                     F.col("hidden").alias("page_hidden"),
                                     F.col("width").alias("page_width"), F.col("height").alias("page_height")),
                        ["model_id", "page_id"])


def measure_usage(measures: DataFrame, visuals: DataFrame, pages: DataFrame,
                  include_system_tables: bool = False) -> DataFrame:
    """Distinct (model_id, measure, page_name, visual) where a cleaned field names the measure."""
    m = measures
    if not include_system_tables:
        m = m.where(~is_system_table("table_name"))
    m = m.where(F.col("name").isNotNull()).select("model_id", F.col("name").alias("measure"),
                                                   F.lower("name").alias("key")).distinct()
    v = with_clean_field_name(visuals_with_page(visuals, pages), "field", "clean")
    # Catalyst traces join keys back to their tables by inlining every projection on the way (pruning and runtime filters), which
    # multiplies the cleaner's steps; a generator ends the trace.  A non-nullable key keeps it from inferring an isnotnull filter.
    uses = (v.select("model_id", "page_name", visual_description("type", "title").alias("visual"),
                     F.explode(F.array(F.coalesce(F.lower("clean"), F.lit("")))).alias("key"))
            .distinct())
    return m.join(uses, ["model_id", "key"]).select("model_id", "measure", "page_name", "visual").distinct()


def usage_counts(usage: DataFrame) -> DataFrame:
    """Number of distinct (page, visual) uses per measure."""
    return usage.groupBy("model_id", "measure").agg(F.count(F.lit(1)).alias("n_visuals"))


def sorted_usage(usage: DataFrame) -> DataFrame:
    """L2: usage rows in (page, visual) order per measure; a range-partitioned sort, no per-measure collect."""
    return usage.orderBy("model_id", "measure", "page_name", "visual")


def _bound_substrings(names: DataFrame, visuals: DataFrame) -> DataFrame:
    """Distinct (model_id, key) substrings of bound fields that could equal a measure name of the model.

    Exact candidate generation: a start position p of field f is kept for
    length n only when the two characters at p begin some name of length n in
    the model.  A field meets its model's name starts as one map before it is
    cut up, so no position is shuffled; a model's fields are dealt into shares,
    so that a model with much of the table is not one task's.  Only models with
    names of one or no character look at the field's characters (the empty name
    occurs in every field).
    """
    starts = names.where(F.length("key") >= 2).groupBy("model_id", F.substring("key", 1, 2).alias("pre")).agg(F.collect_set(F.length("key")).alias("ns"))
    starts = starts.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("pre", "ns"))).alias("starts"))
    starts = starts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(FIELD_SHARES - 1))))
    fields = visuals.where(F.col("model_id").isNotNull() & F.col("field").isNotNull()).select("model_id", F.lower("field").alias("f")).distinct()
    # a model without names finds none: its fields are left out before they are cut up
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("f") - 1, F.lit(1)))).alias("p")
    long = (fields.withColumn("share", F.pmod(F.hash("f"), F.lit(FIELD_SHARES))).join(starts, ["model_id", "share"]).select("model_id", "f", "starts", at)
            .select("model_id", "f", "p", F.explode(F.col("starts")[F.expr("substring(f, p, 2)")]).alias("n"))
            .where(F.col("p") + F.col("n") - 1 <= F.length("f"))
            .select("model_id", F.expr("substring(f, p, n)").alias("key")))
    tiny = names.where(F.length("key") <= 1).select("model_id").distinct()
    short = fields.join(tiny, "model_id", "left_semi").select("model_id", F.explode(F.array_append(F.split("f", ""), F.lit(""))).alias("key"))
    return long.unionByName(short).distinct()


def marked_measures(measures: DataFrame, visuals: DataFrame) -> DataFrame:
    """Distinct (model_id, name, used) of models with visuals: one join marks the names that occur in a bound field."""
    names = (measures.where(F.col("name").isNotNull())
             .select("model_id", F.col("name").cast("string").alias("name")).distinct()
             .withColumn("key", F.lower("name")))
    names = names.join(visuals.select("model_id").distinct(), "model_id", "left_semi")
    found = _bound_substrings(names, visuals).withColumn("used", F.lit(True))
    return names.join(found, ["model_id", "key"], "left").select("model_id", "name", F.coalesce("used", F.lit(False)).alias("used"))


def unused_measures(measures: DataFrame, visuals: DataFrame) -> DataFrame:
    """Measure names (all tables) that occur in no bound field of the model.

    Only models with at least one visual are considered, as the reference
    checks usage only when report pages exist.
    """
    return marked_measures(measures, visuals).where(~F.col("used")).select("model_id", "name")


def unused_report(measures: DataFrame, visuals: DataFrame) -> DataFrame:
    """Unused measures of models where some measures are used (else nothing is reported)."""
    marked = marked_measures(measures, visuals)
    with_use = marked.groupBy("model_id").agg(F.bool_or("used").alias("any_used")).where("any_used").select("model_id")
    return marked.where(~F.col("used")).select("model_id", "name").join(with_use, "model_id", "left_semi")


def unused_top10(report: DataFrame) -> DataFrame:
    """L1: first 10 unused names (sorted) per model and '… and N more'.

    ``row_number() <= 10`` lets Spark insert a map-side group limit before the
    shuffle, so each model ships at most 10 rows per input partition.
    """
    w = Window.partitionBy("model_id").orderBy("name")
    top = report.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= UNUSED_LISTED)
    listed = top.groupBy("model_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("listed"))
    counts = report.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_unused"))
    more = F.when(F.col("n_unused") > UNUSED_LISTED,
                  F.concat(F.lit(" … and "), (F.col("n_unused") - UNUSED_LISTED).cast("string"), F.lit(" more")))
    return (counts.join(listed, "model_id")
            .select("model_id", "n_unused", F.concat(F.col("listed"), F.coalesce(more, F.lit(""))).alias("unused_text")))


def fields_by_well(visual_fields: DataFrame) -> DataFrame:
    """A4: per visual and role, the cleaned field names in order; roles ordered by first appearance.

    Input rows: (model_id, page_id, pos, type, field_no, field).  Measure
    fields are wrapped in <i>; card visuals show X-axis and Value as 'Value'.
    """
    f = with_clean_field_name(visual_fields, "field", "clean").select(
        "model_id", "page_id", "pos", "type", "field_no",
        well_of(F.col("field")).alias("well"),
        F.when(is_measure_field(F.col("field")), F.concat(F.lit("<i>"), escape_html(F.col("clean")), F.lit("</i>")))
        .otherwise(escape_html(F.col("clean"))).alias("display"))
    label = well_label(F.col("well"))
    label = F.when(F.col("type").isin("card", "multiRowCard") & label.isin("X-axis", "Value"), F.lit("Value")).otherwise(label)
    return (f.groupBy("model_id", "page_id", "pos", "type", "well")
            .agg(F.min("field_no").alias("well_order"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_no", "display"))),
                                          lambda s: s["display"]), ", ").alias("fields"))
            .select("model_id", "page_id", "pos", "well", label.alias("well_label"), "well_order", "fields"))
