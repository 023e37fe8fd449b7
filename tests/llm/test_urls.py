import math
import re
from collections import Counter

from fleetcat.llm import op6

from .helpers import ASCII_LOWER, CLASHES


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return m.group(1).translate(ASCII_LOWER), m.group(2)


def fitting(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in op6.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?q=/de/", "http://example.net", "https://a.example.com/de/1#x", "https://a.example.com/fr/1",
        "ftp://notexample.net/en/1", "http://b.org/fr/", "http://b.org/FR/", "http://net/x", "http://x.net?y://z/en/", "http://a.example.com/de", "x://y://example.net/en/",
        "http://casinowin.example.com/fr/77", "http://goodnews.example.com/es/1", "https://ünï.org/de/zü", "http://a..net/", "http://a b.com/c\nd"]


def pages_df(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in CLASHES))


def pages():
    rows = [(i, u, "<p>casino win good news casino win</p>") for i, u in enumerate(URLS)]
    rows += [(100 + i, f"http://casino{'win' * (i % 2)}{i % 3}.net/x/{i}", "<b>the casino</b> <script>var bad</script>") for i in range(20)]
    rows += [(200 + i, f"http://good{'news' * (i % 2)}.example.net/en/{i}", None) for i in range(20)]
    return rows + [rows[4], (4, URLS[6], ""), (None, URLS[5], "x")]


def naive_bayes(rows, words):
    """Block scores by url, counted in plain Python over the operator's own segmentation."""
    def features(url):
        host, path = parse(url)
        out = []
        for tag, part in (("h", host), ("p", path.translate(ASCII_LOWER))):
            for run in re.findall(r"[^\W\d_]+|\d+", part):
                out += [(tag, w) for w in words.get(run, [f"#{len(run)}"])]
        return out

    counts, n = {"block": Counter(), "allow": Counter()}, Counter()
    for _, url, _ in rows:
        verdict = fitting(*parse(url))[1]
        if verdict:
            n[verdict] += 1
            counts[verdict].update(features(url))
    v = len(counts["block"] | counts["allow"])
    total = {k: sum(c.values()) for k, c in counts.items()}
    return {url: math.log(n["block"] / n["allow"]) + sum(
        math.log((counts["block"][f] + 1) / (total["block"] + v)) - math.log((counts["allow"][f] + 1) / (total["allow"] + v)) for f in features(url)) for _, url, _ in rows}


def test_rules_segmentation_and_scores(spark):
    rows = pages()
    df = pages_df(spark, rows)
    got = op6.judge(df, op6.rules_table(spark)).collect()
    assert len(got) == len(rows)
    runs = {r for _, u, _ in rows for part in parse(u) for r in re.findall(r"[^\W\d_]+", part.translate(ASCII_LOWER))}
    counts = op6.word_counts(df.select("html"))
    words = {r.run: r.words for r in op6.segmented(spark.createDataFrame([(r,) for r in runs], "run string"), counts).collect()}
    assert words["casinowin"] == ["casino", "win"] and words["goodnews"] == ["good", "news"]
    scores = naive_bayes(rows, words)
    want = []
    for i, u, _ in rows:
        host, path = parse(u)
        rule, verdict = fitting(host, path)
        want.append((i, host, path, rule, verdict or ("block" if round(scores[u], 6) > 0 else "allow"), None if rule else round(scores[u], 4)))
    assert sorted(map(str, want)) == sorted(str((*r[:5], None if r[5] is None else round(r[5], 4))) for r in got)
    by_id = {r.page_id: r for r in got}
    assert by_id[15].verdict == "block" and by_id[16].verdict == "allow"


def test_without_examples_of_both_kinds_everything_is_allowed(spark):
    rows = [(1, "http://a.com/x", "a"), (2, "http://b.net/x", "b")]
    assert {r.page_id: r.verdict for r in op6.judge(pages_df(spark, rows), op6.rules_table(spark)).collect()} == {1: "allow", 2: "block"}
    assert op6.judge(pages_df(spark, rows).limit(0), op6.rules_table(spark)).collect() == []


def test_viterbi_equals_all_splits():
    counts = {"a": 50, "ab": 9, "abc": 3, "bc": 20, "c": 4, "cab": 6, "b": 1}
    total = sum(counts.values())

    def splits(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) for rest in splits(s[k:])]

    def p(ws):
        return sum(math.log10(counts[w] / total) if w in counts else 1 - math.log10(total) - len(w) for w in ws)

    for s in ("abc", "cabab", "zabzz", "bcabca", "q"):
        hits = [{"at": i + 1, "n": n, "c": counts[s[i:i + n]]} for i in range(len(s)) for n in range(1, 4) if s[i:i + n] in counts and i + n <= len(s)]
        assert abs(p(op6.split_run(s, hits, total)) - max(map(p, splits(s)))) < 1e-9


def test_words_of_any_length(spark):
    """Words around the lookup length and beyond, inside runs that span chunks, against all lengths tried in plain Python."""
    import random
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    vocabulary = {letters(n): rng.randrange(1, 50) for n in (1, 2, 3, 5, 8, 20, 21, 40, 63, 64, 65, 66, 100, 300, 700)}
    long = next(w for w in vocabulary if len(w) == 300)
    vocabulary[long[:200]] = 7
    names = list(vocabulary)
    runs = {"".join(rng.choice([*names, letters(4)]) for _ in range(rng.randrange(1, 9))) for _ in range(25)} | {long, long[:-1], "x", letters(1000)}
    total = sum(vocabulary.values())
    counts = spark.createDataFrame(list(vocabulary.items()), "word string, c long")
    got = {r.run: r.words for r in op6.segmented(spark.createDataFrame([(r,) for r in runs], "run string"), counts).collect()}
    for run in runs:
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            top, at = -math.inf, 0
            for start in range(end):
                c = vocabulary.get(run[start:end])
                p = best[start] + (math.log10(c) - math.log10(total) if c else 1 - math.log10(total) - (end - start))
                if p > top + 1e-12:
                    top, at = p, start
            best.append(top)
            back.append(at)
        words, end = [], len(run)
        while end:
            words.append(run[back[end]:end])
            end = back[end]
        assert got[run] == words[::-1]
    assert op6.segmented(spark.createDataFrame([("abc",)], "run string"), counts.limit(0)).collect()[0].words == ["a", "b", "c"]  # no unigram model: N is 1


def test_a_very_long_run(spark):
    import time
    run = "casinowin" * 22_000
    counts = spark.createDataFrame([("casino", 5), ("win", 9), ("in", 2), ("a", 1)], "word string, c long")
    began = time.time()
    words = op6.segmented(spark.createDataFrame([(run,)], "run string"), counts).collect()[0].words
    assert words == ["casino", "win"] * 22_000 and time.time() - began < 60
