"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets, repeated epochs.

Method
  * Sources, in code point order with null last, get weights 3, 1, 2 in turn.
    Targets share ``SHARE`` percent of all words by weight; a target stops at
    ``MAX_EPOCHS`` times its source's size and the excess goes to the others
    by weight (water filling: over prefix sums of the sources sorted by
    cap / weight, the level is what is left over the weight that is left).
  * Inside a source documents are ordered by a hash of id and text.  The rows
    (without texts) are range-sorted by (source, hash) over all tasks; a
    running sum inside each task plus the sums of the tasks before gives each
    document's exact place in its source, so no source meets in one task.
  * A source whose target is e times its size and a rest takes every document
    e times, and once more the documents that lie before the rest; the
    document at the rest's end is cut there.  Sums meet targets to the word.

Defined cases: null text has size 0; null source is a source of its own; rows
that repeat an id are separate documents; equal rows are ordered by their
place in the sort, which changes no multiset of results; a source of size 0
has target 0.  No rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcat.llm.runtime import written

WEIGHTS = (3, 1, 2)
SHARE = 150  # percent of all words
MAX_EPOCHS = 2
SEED = "mix-7"
_TAG = uuid.uuid4().hex  # ends the names of columns that stand beside a caller's

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over earlier rows of the group, without gathering a group in one task.

    The rows are written range-sorted, one file per task, so that their order
    and their task numbers stay fixed for the passes that follow.
    """
    rows = df.repartitionByRange(*[F.col(c) for c in [group, *order]]).withColumn("__task", F.spark_partition_id())
    rows = written(rows, name)
    per_task = rows.groupBy("__task", group).agg(F.sum(value).alias("s"))
    earlier = Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select(F.col("__task").alias("__t"), F.col(group).alias("__g"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__task", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(offsets, (F.col("__task") == F.col("__t")) & F.col(group).eqNullSafe(F.col("__g"))) \
        .withColumn("before", F.col("__own") + F.col("__offset")).drop("__own", "__offset", "__t", "__g", "__task")


def targets(sizes: DataFrame, weights=WEIGHTS, share: int = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source (one row each: source, source_size) its target: source, source_size, target."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), F.col("source"))
    spelled = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", spelled).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    total = F.sum("source_size").over(everything) * (share / 100)
    full = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    heavy = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (total - full) / heavy).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * free).alias("target"))


def random_key() -> Column:
    """Hash-random order inside a source, the same on every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string"), F.col("text")))


def _planned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc rows with key and place, plan per source)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"), random_key().alias("key"))
    placed = prefix_sums(rows, "source", ["key", "size"], "size", "mix-order")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes)
    budget = F.floor(F.round("target", 6)).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    return placed, plan.withColumn("epochs", whole).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    placed, plan = _planned(docs)
    p = plan.withColumnRenamed("source", "s")
    extra = F.least(F.col("size"), F.greatest(F.col("rest") - F.col("before"), F.lit(0)))
    return placed.join(p, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"),
        (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a document taken twice is two rows, one cut by the budget keeps its first words.

    Texts are not sorted: each source's plan comes down to the key at which
    its last epoch ends, and documents compare their own key with it.  Equal
    rows (same id and text) that lie at the cut share it evenly.  Documents
    without words have nothing to take and stay once.
    """
    placed, plan = _planned(docs)
    p = plan.withColumnRenamed("source", "s")
    at = placed.join(p, F.col("source").eqNullSafe(F.col("s"))).where("before < rest and before + size >= rest").groupBy("s").agg(
        F.min("key").alias("cut_key"), F.max("rest").alias("rest"))
    at = placed.join(at.withColumnRenamed("s", "s2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("key") == F.col("cut_key"))).groupBy("s2").agg(
        F.min("cut_key").alias("cut_key"), F.floor((F.max("rest") - F.min("before")) / F.count("*")).cast("long").alias("cut_size"))
    ends = written(p.drop("rest").join(at, F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2"), "mix-plan")
    cols = list(docs.columns)
    own = lambda name: f"{name}_{_TAG}"
    key, size, epochs, cut, cut_size, n, part, copy = (F.col(own(x)) for x in ("key", "size", "epochs", "cut", "cut_size", "n", "part", "copy"))
    rows = docs.select(*[F.col(f"`{c}`") for c in cols], random_key().alias(own("key")), word_count(F.col("text")).alias(own("size")))
    rows = rows.join(ends.select(F.col("s").alias(own("s")), F.col("epochs").alias(own("epochs")), F.col("cut_key").alias(own("cut")),
                                 F.col("cut_size").alias(own("cut_size"))),
                     F.col("source").cast("string").eqNullSafe(F.col(own("s"))), "left")
    partial = (key == cut) & (cut_size < size)
    last = F.when(key < cut, size).when(key == cut, F.least(cut_size, size)).otherwise(0)
    copies = F.when(size == 0, 1).otherwise(epochs + F.when(last > 0, 1).otherwise(0))
    rows = rows.withColumn(own("n"), copies.cast("int")).where(n > 0) \
        .withColumn(own("part"), F.when(partial, cut_size)) \
        .withColumn(own("copy"), F.explode(F.sequence(F.lit(1), n)))
    is_cut = (copy == n) & part.isNotNull()
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    out = rows.withColumn("text", F.when(is_cut, F.array_join(F.slice(words, F.lit(1), part.cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(is_cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in cols])
