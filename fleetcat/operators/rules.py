"""P10 with any number of rules: first matching keyword by priority, through the keywords' rarest grams.

``functions.code.classify_source`` tries every rule on every text, one CASE
branch per rule.  Here rules are a table.  Each rule is filed under the one of
its grams that the fewest rules have, of the longest size of ``GRAMS`` that
fits it (short grams alone would be shared by ever more rules); each distinct text is exploded into its distinct grams, without the
text itself, and meets the rules filed there by an equi-join.  Only these pairs
are checked with ``contains``.  The result equals trying all rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcat.functions.code import classify_source
from fleetcat.operators.search import GRAM, grams_of
from fleetcat.session import cut_lineage

GRAMS = (1, 2, 3, 6, 12, 24)  # a keyword is filed under grams of the longest of these sizes that fits it


def first_rules(texts: DataFrame, text_col: str, rules: DataFrame) -> DataFrame:
    """(text, priority, keyword, category, connection_type) of the first matching rule of each distinct text that has one.

    ``rules``: (priority, keyword, category, connection_type); equal priorities
    go by keyword, then category and type.  Null keywords match nothing, empty
    ones everything.
    """
    rule = ["priority", "keyword", "category", "connection_type"]
    first = F.min(F.struct("priority", "category", "connection_type"))  # of the rules of one keyword only the first can win
    own = rules.where(F.col("keyword").isNotNull()).groupBy("keyword").agg(first.alias("r"))
    own = cut_lineage(own.select("r.priority", "keyword", "r.category", "r.connection_type"), "rules")
    key = F.col("keyword")
    size = F.length(key)
    fits = F.lit(0)
    for n in GRAMS:
        fits = F.when(size >= n, F.lit(n)).otherwise(fits)
    own_grams = F.when(fits == 0, F.array(F.lit(""))).otherwise(grams_of(key, [F.greatest(fits, F.lit(1))]))
    filed = own.select("keyword", F.explode(own_grams).alias("gram"))
    shared = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n_rules"))
    rarest = Window.partitionBy("keyword").orderBy("n_rules", F.length("gram").desc(), "gram")  # the grams of one keyword
    filed = filed.join(shared.hint("merge"), "gram").withColumn("k", F.row_number().over(rarest)).where("k = 1").select("keyword", "gram")
    filed = cut_lineage(filed, "rule-grams")
    sizes = [r[0] for r in filed.select(F.length("gram").alias("n")).distinct().collect()]  # GRAMS and 0 at most
    every = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct()
    every = cut_lineage(every.withColumn("id", F.monotonically_increasing_id()), "rule-texts")
    gram = F.explode(F.concat(F.array(F.lit("")), grams_of(F.col("text"), [n for n in sizes if n])) if 0 in sizes else grams_of(F.col("text"), sizes or [GRAM]))
    # merges: the size of a packed file says little about its rows, a broadcast would pass them all through the driver
    pairs = every.select("id", gram.alias("gram")).join(filed.hint("merge"), "gram").select("id", "keyword")
    found = pairs.join(every.hint("merge"), "id").where(F.col("text").contains(F.col("keyword"))).select("text", "keyword")
    return found.join(own.hint("merge"), "keyword").groupBy("text").agg(F.min(F.struct(*rule)).alias("rule")).select("text", "rule.*")


def classify_by_rules(df: DataFrame, text_col: str, rules: DataFrame) -> DataFrame:
    """P10: ``df`` with category and connection_type; texts without a matching rule as ``classify_source`` has them."""
    found = first_rules(df, text_col, rules).select(F.col("text").alias("_text"), F.col("category").alias("_c"), F.col("connection_type").alias("_t"))
    rest = classify_source(text_col, rules=())
    matched = F.col("_text").isNotNull()
    return df.join(found.hint("merge"), F.col(text_col) == F.col("_text"), "left") \
        .withColumn("category", F.when(matched, F.col("_c")).otherwise(rest["category"])) \
        .withColumn("connection_type", F.when(matched, F.col("_t")).otherwise(rest["connection_type"])).drop("_text", "_c", "_t")
