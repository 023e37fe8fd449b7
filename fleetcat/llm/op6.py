"""URL filters: longest-match rules, and naive Bayes over Viterbi-segmented host and path words.

Method
  * Host and path are cut from the url with string functions.  Rules meet hosts
    by an equi-join on the host and its parent domains; of the rules whose path
    starts the url's path, the longest wins.
  * Names run words together.  A unigram model (counts of the words in the
    pages' own texts, of any length) and Viterbi search split each distinct run
    of letters.  A run is cut into chunks, and its substrings of the lengths
    that words have (up to ``LONG``) are joined to the counts under the run's
    hash, so the vocabulary is never broadcast and no row holds a long run;
    longer words are found by their first ``LONG`` letters and compared whole.
    An unknown word of n letters has the probability 10 / (N * 10^n).
  * Urls that a rule decides are the labelled examples of a multinomial naive
    Bayes model (add-one) over host words and path words, kept apart; numbers
    count by their length.  Urls without a rule get its verdict.
  Everything is computed once per distinct url, so repeated urls cost nothing.

Defined cases: a null url or one without ``://`` has an empty host and path,
fits no rule and is judged by the prior alone.  If the rules decide urls of
one kind only (or none), urls without a rule are allowed.  Rules of equal
length tie by their text.  Repeated page ids are judged each; extra columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcat.llm.runtime import map_arrow, written

LONG = 64  # letters of a word that are looked up as such
CHUNK = 256  # starts of substrings that one row generates
HEAVY = 200  # a url part that is more than one in so many is joined by broadcast
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return lower(F.coalesce(host, F.lit(""))), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with ``rule`` and ``rule_verdict`` of the longest rule that fits, else null."""
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = urls.select("host").distinct().withColumn("rule_host", F.explode(domains)).join(rules, "rule_host")
    hosts = hosts.groupBy("host").agg(F.collect_list(F.struct("rule_host", "rule_path", "verdict")).alias("rules"))  # rules of one name's domains
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    ranked = F.array_sort(F.transform(fits, lambda r: F.struct(
        (-F.length(F.concat(r["rule_host"], r["rule_path"]))).alias("n"), F.concat(r["rule_host"], r["rule_path"]).alias("rule"), r["verdict"].alias("verdict"))))
    best = F.get(ranked, F.lit(0))
    return urls.join(hosts, "host", "left").select("url", "host", "path", best["rule"].alias("rule"), best["verdict"].alias("rule_verdict"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c): letters-only words of the column ``html`` without tags, scripts and styles."""
    plain = F.regexp_replace(F.col("html"), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    words = F.explode(F.split(lower(plain), r"[^\p{L}]+"))
    return texts.select(words.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("c"))


def split_run(run: str, hits: list[dict], total: float) -> list[str]:
    """Most probable split of a run of letters; ties go to the longer last word.

    ``hits``: known words by place (``at`` from 1, ``n`` letters, count ``c``).
    The best unknown last word begins where best + start is greatest, which is
    kept while the run is read, so the work is linear in letters and hits.
    """
    by_end: dict[int, list] = {}
    for h in hits:
        by_end.setdefault(h["at"] - 1 + h["n"], []).append((h["at"] - 1, h["c"]))
    log_total = math.log10(max(total, 1))
    best, back = [0.0] * (len(run) + 1), [0] * (len(run) + 1)
    lead, start_of_lead = 0.0, 0  # greatest best[start] + start so far
    for end in range(1, len(run) + 1):
        options = [(start, best[start] + math.log10(c) - log_total) for start, c in by_end.get(end, ())]
        options.append((start_of_lead, lead - end + 1 - log_total))
        top = -math.inf
        for start, p in sorted(options):
            if p > top + 1e-12:
                top, back[end] = p, start
        best[end] = top
        if top + end > lead + 1e-12:
            lead, start_of_lead = top + end, end
    out, end = [], len(run)
    while end:
        out.append(run[back[end]:end])
        end = back[end]
    return out[::-1]


def _viterbi(batches, total: float):
    for batch in batches:
        runs, hits = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):  # a run and its hits at a time
            words = split_run(runs[i].as_py(), hits[i].as_py() or [], total)
            yield pa.RecordBatch.from_arrays([runs.slice(i, 1), pa.array([words], pa.list_(pa.string()))], names=["run", "words"])


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) for distinct runs of letters."""
    counts = counts.withColumn("n", F.length("word"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    lengths = sorted(r[0] for r in counts.select(F.least("n", F.lit(LONG)).alias("n")).distinct().collect())  # LONG at most
    keyed = written(runs.select(F.unhex(F.md5("run")).alias("id"), "run"), "url-runs")
    if not lengths:
        return map_arrow(keyed.select("run", F.lit(None).cast("array<struct<at:int,n:int,c:bigint>>").alias("hits")), partial(_viterbi, total=0.0), "run string, words array<string>")
    n = F.length("run")
    chunks = keyed.select("id", n.alias("length"), "run", F.explode(F.sequence(F.lit(0), F.ceil(n / CHUNK).cast("int") - 1)).alias("chunk"))
    chunks = chunks.select("id", "length", "chunk", F.substring("run", F.col("chunk") * CHUNK + 1, F.lit(CHUNK + LONG - 1)).alias("part"))
    starts = F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.col("length") - F.col("chunk") * CHUNK))
    sizes = F.array(*[F.lit(x) for x in lengths])
    subs = F.flatten(F.transform(starts, lambda i: F.transform(
        F.filter(sizes, lambda k: k <= F.length("part") - i + 1),
        lambda k: F.struct((F.col("chunk") * CHUNK + i).alias("at"), F.col("part").substr(i, k).alias("word")))))
    pieces = chunks.select("id", F.explode(subs).alias("s")).select("id", "s.at", "s.word")
    known = pieces.join(counts.where(F.col("n") <= LONG), "word").select("id", "at", "n", "c")
    if lengths[-1] == LONG:  # words that are longer: the rest is compared in the run
        long = counts.where(F.col("n") > LONG).select(F.substring("word", 1, LONG).alias("head"), "word", "n", "c")
        seeds = pieces.where(F.length("word") == LONG).withColumnRenamed("word", "head").join(long, "head")
        whole = seeds.join(keyed, "id").where(F.col("run").substr(F.col("at"), F.col("n")) == F.col("word"))
        known = known.unionAll(whole.select("id", "at", "n", "c"))
    hits = known.groupBy("id").agg(F.collect_list(F.struct("at", "n", "c")).alias("hits"))  # of one run
    return map_arrow(keyed.join(hits, "id", "left").select("run", "hits"), partial(_viterbi, total=float(total)), "run string, words array<string>")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, block_score (log odds; null where a rule decides)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = rows.groupBy("url").agg(F.count("*").alias("pages")).withColumn("host", host).withColumn("path", path)
    ruled = written(rule_of(urls.drop("pages"), rules).join(urls.select(F.col("url").alias("u"), "pages"), F.col("url").eqNullSafe(F.col("u"))).drop("u"), "url-rules")

    run = r"\p{L}+|\p{N}+"
    side = lambda c, tag: F.transform(F.expr(f"regexp_extract_all({c}, r'{run}', 0)"), lambda r: F.struct(F.lit(tag).alias("tag"), r.alias("run")))
    parts = ruled.withColumn("path_lower", lower(F.col("path"))).select("url", "pages", "rule_verdict", F.explode(F.concat(side("host", "h"), side("path_lower", "p"))).alias("t")) \
        .select("url", "pages", "rule_verdict", "t.tag", "t.run")
    letters = parts.where(F.col("run").rlike(r"^\p{L}")).select("run").distinct()
    counts = written(word_counts(pages.select(F.col("html").cast("string").alias("html"))), "url-unigrams")  # used twice
    words = written(segmented(letters, counts), "url-words")

    # naive Bayes: one row per (tag, word); training rows are added up per run before words are
    runs = parts.where("rule_verdict is not null").groupBy("tag", "run").agg(
        *[F.sum(F.when(F.col("rule_verdict") == v, F.col("pages")).otherwise(0)).alias(v) for v in ("block", "allow")])

    def with_words(df: DataFrame) -> DataFrame:
        got = df.join(words, "run", "left")
        return got.withColumn("word", F.explode(F.coalesce("words", F.array(F.concat(F.lit("#"), F.length("run").cast("string")))))).drop("words")

    seen = written(with_words(runs).groupBy("tag", "word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "url-counts")
    sums = seen.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    prior = ruled.agg(*[F.sum(F.when(F.col("rule_verdict") == v, F.col("pages"))) for v in ("block", "allow")]).first()
    n_block, n_allow, v = sums[0] or 0, sums[1] or 0, sums[2] or 0
    if prior[0] and prior[1]:
        odds = lambda b, a: F.log((b + 1) / F.lit(float(n_block + v))) - F.log((a + 1) / F.lit(float(n_allow + v)))
        weight = with_words(parts.select("tag", "run").distinct()).join(seen, ["tag", "word"], "left") \
            .groupBy("tag", "run").agg(F.sum(odds(F.coalesce("block", F.lit(0)), F.coalesce("allow", F.lit(0)))).alias("w"))
        # parts that are in very many urls (HEAVY of them at most) meet their weight by broadcast, the others by a shuffle
        weight = written(weight, "url-weights")
        open_parts = parts.where("rule_verdict is null").select("url", "tag", "run")
        often = open_parts.groupBy("tag", "run").agg(F.count("*").alias("n"))
        every = open_parts.select(F.count("*")).scalar()
        heavy = weight.join(written(often.where(F.col("n") * HEAVY > every), "url-heavy"), ["tag", "run"]).select("tag", "run", F.col("w").alias("heavy_w"))
        marked = open_parts.join(F.broadcast(heavy), ["tag", "run"], "left")
        scored = marked.where("heavy_w is null").join(weight, ["tag", "run"]).select("url", "w") \
            .unionAll(marked.where("heavy_w is not null").select("url", F.col("heavy_w").alias("w")))
        scored = scored.groupBy(F.col("url").alias("u")).agg(F.sum("w").alias("w"))
        score = F.round(F.coalesce("w", F.lit(0.0)) + math.log(prior[0] / prior[1]), 6)
        judged = ruled.join(scored, F.col("url") == F.col("u"), "left").withColumn("block_score", F.when(F.col("rule").isNull(), score)).drop("u", "w")
    else:
        judged = ruled.withColumn("block_score", F.lit(None).cast("double"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") > 0, "block").otherwise("allow"))
    judged = judged.select(F.col("url").alias("u"), "host", "path", "rule", verdict.alias("verdict"), "block_score")
    return rows.join(judged, F.col("url").eqNullSafe(F.col("u"))).select("page_id", "host", "path", "rule", "verdict", "block_score")


def rules_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
