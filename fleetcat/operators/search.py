"""Case-insensitive containment search over the whole catalog, through an n-gram posting table.

An entry is a line of the documentation's navigation: a path of labels below a
model (section, table, item).  It matches a query that its last label contains;
with it come the entries above it.

The index is written once and answers many queries in one join:

* ``labels``: the distinct lower-cased labels, posted once per character under
  the GRAM characters from there on (fewer at the end).
* ``grams``: how many postings each gram has.
* ``entries``: every entry with its label.

A query is looked up by its rarest gram; one shorter than a gram by the grams
that it begins.  A posting is tried once per distinct (gram, offset, length) of
the queries: the text of that length at that place is joined to the queries, so
work follows postings and matches, never queries times postings.  A label's
first match of a text counts, so each (query, label) comes once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcat.functions.common import py_strip
from fleetcat.functions.names import is_system_table
from fleetcat.operators.scope import source_sections
from fleetcat.session import cut_lineage

GRAM = 3

# titles of the documentation's sections (fixed values)
SOURCES, QUERIES, MEASURES, COLUMNS, PAGES, GROUPS = (
    "Data Sources", "Power Query Transformations", "DAX Measures", "DAX Calculated Columns", "Report Pages", "Calculation Groups")


def catalog_entries(measures: DataFrame, columns: DataFrame, partitions: DataFrame, expressions: DataFrame, pages: DataFrame,
                    items: DataFrame | None = None) -> DataFrame:
    """(model_id, path, label): source sections, query tables, measures and calculated columns by table, pages, calculation items.

    System tables are left out.  ``items``: (model_id, group, name) of calculation groups.
    """
    def leaves(df: DataFrame, section: str, *labels: str) -> DataFrame:
        return df.select("model_id", F.array(F.lit(section), *[F.col(c).cast("string") for c in labels]).alias("path"))

    own = [df.where(~is_system_table("table_name")) for df in (partitions, measures, columns.where("is_calculated"))]
    parts = [leaves(source_sections(partitions, expressions), SOURCES, "section"), leaves(own[0], QUERIES, "table_name"),
             leaves(own[1], MEASURES, "table_name", "name"), leaves(own[2], COLUMNS, "table_name", "column_name"), leaves(pages, PAGES, "page_name")]
    if items is not None:
        parts.append(leaves(items, GROUPS, "group", "name"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return _with_ancestors(every, "model_id", "path").distinct().withColumn("label", F.element_at("path", -1))


def _with_ancestors(df: DataFrame, *columns: str) -> DataFrame:
    """One row per prefix of ``path``."""
    return df.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("path")))).withColumn("path", F.slice("path", F.lit(1), F.col("n"))).select(*columns)


def grams_of(text: Column, sizes) -> Column:
    """Distinct substrings of the sizes (a size beyond the text has none)."""
    def of_size(n):
        count = F.length(text) - n + 1
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of_size(n) for n in sizes])))


@dataclass(frozen=True)
class SearchIndex:
    """Folders of the three tables of an index."""

    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def build_index(entries: DataFrame, path: str) -> SearchIndex:
    """Write the index of ``entries`` (model_id, path, label, ...; with the entries above them) below ``path``."""
    spark = entries.sparkSession
    index = SearchIndex(path.rstrip("/"))
    entries.withColumn("lower_label", F.lower("label")).write.mode("overwrite").parquet(f"{index.path}/entries")
    labels = index.table(spark, "entries").where("lower_label is not null").select("lower_label").distinct()
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("lower_label"), F.lit(1)))).alias("at")
    postings = labels.select("lower_label", at).select(F.substring("lower_label", F.col("at"), F.lit(GRAM)).alias("gram"), "at", "lower_label")
    # sorted by gram: a lookup skips the other row groups of a file
    postings.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{index.path}/labels")
    index.table(spark, "labels").groupBy("gram").agg(F.count(F.lit(1)).alias("n_labels")).write.mode("overwrite").parquet(f"{index.path}/grams")
    return index


def _lookups(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """(query, text, gram, offset, n): where each text is looked up, by its rarest gram or the grams that it begins."""
    grams = index.table(asked.sparkSession, "grams")
    n = F.length("text")
    texts = asked.select("text", n.alias("n")).distinct()
    parts = texts.where(F.col("n") >= GRAM).select("text", "n", F.explode(F.sequence(F.lit(0), F.col("n") - GRAM)).alias("offset"))
    parts = parts.withColumn("gram", F.substring("text", F.col("offset") + 1, F.lit(GRAM))).join(grams, "gram", "left")
    rarest = parts.groupBy("text", "n").agg(F.min(F.struct(F.coalesce("n_labels", F.lit(0)).alias("n_labels"), "offset", "gram")).alias("best"))
    begun = grams.select("gram", F.explode(F.array_distinct(F.array(*[F.substring("gram", 1, k) for k in range(GRAM)]))).alias("text"))
    short = texts.where(F.col("n") < GRAM).join(begun, "text").select("text", "gram", F.lit(0).alias("offset"), "n")
    places = rarest.select("text", "best.gram", "best.offset", "n").unionByName(short)
    return asked.join(places, "text").select("query", "text", "gram", "offset", "n")


def search(index: SearchIndex, queries: DataFrame, query_col: str = "query") -> DataFrame:
    """(query, model_id, path, label, is_match) of the entries that match each distinct query, and of the entries above them.

    A query is stripped and lower-cased first; an empty one matches every
    entry, a null one none.
    """
    spark = queries.sparkSession
    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("query")).distinct().withColumn("text", F.lower(py_strip(F.col("query"))))
    # written, so that their sizes are known where the joins with the postings are planned
    lookups = cut_lineage(_lookups(index, asked), "lookups")
    places = cut_lineage(lookups.select("gram", "offset", "n").distinct(), "places")
    label, first, n = F.col("lower_label"), F.col("first"), F.col("n")
    tried = index.table(spark, "labels").join(places, "gram").withColumn("first", F.col("at") - F.col("offset"))
    tried = tried.where((first >= 1) & (first + n - 1 <= F.length(label))).withColumn("text", F.substring(label, first, n))
    tried = tried.where(F.instr(label, F.col("text")) == first)
    found = tried.join(lookups, ["gram", "offset", "n", "text"]).select("query", "text", "lower_label")
    hits = found.join(index.table(spark, "entries"), "lower_label").select("query", "text", "model_id", "path")
    above = _with_ancestors(hits.where(F.size("path") > 1).withColumn("path", F.slice("path", F.lit(1), F.size("path") - 1)), "query", "text", "model_id", "path")
    # an entry above that matches too is among the hits
    above = above.distinct().where(~F.coalesce(F.lower(F.element_at("path", -1)).contains(F.col("text")), F.lit(False)))
    rows = hits.withColumn("is_match", F.lit(True)).unionByName(above.withColumn("is_match", F.lit(False)))
    return rows.select("query", "model_id", "path", F.element_at("path", -1).alias("label"), "is_match")
