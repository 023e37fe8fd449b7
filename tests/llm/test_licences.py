import math
import random
import re
from collections import Counter

from fleetcat.llm import op2
from fleetcat.llm.queries import QUERIES

from .helpers import ASCII_LOWER

TEXTS = {
    "a/LICENSE": "Released under the MIT License.", "a/x.py": "code", "a/b/c/y.py": "Licensed under the Apache License, Version 2.0.\nmore",
    "a/b/c/z.py": None, "a/b/COPYING.txt": "This work is licensed\nunder the GNU General Public License, version 3.", "a/b/LICENSE": "nothing of the kind",
    "d/e.txt": "", "d/licence.md": "LICENSED under cc by-nc 4.0", "d/f/g/h/i.txt": "the the the", "top.txt": "Licensed under CC BY 4.0 and many other words that make the line long and far away",
    "LICENSES/x": "a\n\n \nb", "a/both.txt": "Released under the MIT License.\nLicensed under CC BY-SA 4.0.", "ab/x.py": "not below a/",
}


def terms(text):
    return re.findall(op2.TERM, text.translate(ASCII_LOWER))


def brute(files):
    lines = [x for _, t in files for x in (t or "").split("\n") if x.strip(" ")] if files else []
    df = Counter(t for x in lines for t in set(terms(x)))
    vocabulary = {t for _, b in op2.TEMPLATES for t in terms(b)}
    idf = lambda t: math.log((len(lines) + 1) / ((df[t] if t in vocabulary else 0) + 1)) + 1
    vec = lambda ts: {t: n * idf(t) for t, n in Counter(ts).items()}

    def best(path, text):
        segments = text.split("\n") if text is not None else []
        if text is not None and path and re.match(op2.LICENCE_NAMES, path.rsplit("/", 1)[-1].lower()):
            segments = [*segments, text]
        found = []
        for s in segments:
            v = vec(terms(s))
            for name, body in op2.TEMPLATES:
                w = vec(terms(body))
                if v:
                    cos = sum(x * w.get(t, 0) for t, x in v.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values()))
                    if round(cos, 6) >= op2.THRESHOLD:
                        found.append((-round(cos, 6), name))
        return min(found) if found else None

    own = [(p, best(p, t)) for p, t in files]
    folders = {}
    for p, b in own:
        if b and p and re.match(op2.LICENCE_NAMES, p.rsplit("/", 1)[-1].lower()):
            f = p[:p.rfind("/") + 1]
            folders[f] = min(folders.get(f, (*b, p)), (*b, p))
    out = []
    for p, b in own:
        near = None
        if p is not None:
            f = p[:p.rfind("/") + 1]
            near = max((g for g in folders if f.startswith(g)), key=len, default=None)
        out.append((p, b[1] if b else None, b[1] if b else folders[near][1] if near is not None else None))
    return out


def files_df(spark, files):
    return spark.createDataFrame([(i, p, t, "x", "y") for i, (p, t) in enumerate(files)], "file_id long, path string, text string, own string, folder string")


def test_equal_to_brute_force(spark):
    files = [*TEXTS.items(), (None, "Released under the MIT License."), (None, None), ("a/x.py", "code"), ("a/b/LICENSE", "Released under the MIT License."),
             ("long/x", "word " * 20000 + "\nReleased under the MIT License.")]
    got = op2.scan(files_df(spark, files).repartition(4)).collect()
    assert sorted(map(str, ((r.path, r.own_licence, r.licence) for r in got))) == sorted(map(str, brute(files)))
    by = {r.path: r for r in got}
    assert by["a/x.py"].licence == "MIT" and by["a/x.py"].origin == "inherited" and by["a/x.py"].licence_folder == "a/"
    assert by["a/b/c/y.py"].origin == "header" and by["d/f/g/h/i.txt"].licence == "CC-BY-NC-4.0" and by["ab/x.py"].origin == "none"
    assert by["a/b/COPYING.txt"].origin == "licence file" and by["long/x"].own_licence == "MIT"


def test_no_files(spark):
    assert op2.scan(files_df(spark, list(TEXTS.items())).limit(0)).collect() == []


def test_plan_has_no_python(spark):
    plan = op2.own_licences(files_df(spark, list(TEXTS.items())))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_windows_find_notices_among_other_words(spark):
    filler = "plain words of a long paragraph that go on and on without a word about rights".split()
    around = lambda notice, n: " ".join([*(filler * 9)[:n], notice, *(filler * 9)[:n]])
    wanted = {f"{i}_{n}/x": (name, around(body, n)) for i, (name, body) in enumerate(op2.TEMPLATES) for n in (10, 15, 120)}
    wanted |= {f"wrapped_{i}/x": (name, "int x;\n# " + "\n# ".join(" ".join(w[j:j + 3]) for j in range(0, len(w), 3)) + "\nmore code here")
               for i, (name, body) in enumerate(op2.TEMPLATES) for w in [body.split()]}
    wanted |= {
        "jane/x": ("MIT", "Copyright (c) 2021 Jane Doe. Released under the MIT License."),
        "foo/x": ("CC-BY-4.0", "(c) 2020 Foo Inc., Licensed under CC BY 4.0."),
        "spdx/x": ("MIT", "// SPDX-License-Identifier: MIT"), "spdx/or": ("GPL-3.0", around("SPDX-License-Identifier: GPL-3.0-or-later", 40)),
        "spdx/other": (None, "# SPDX-License-Identifier: ISC"), "spdx/end": (None, "ends in SPDX-License-Identifier"),
        "plain/x": (None, " ".join(filler * 30)), "empty/x": (None, ""), "null/x": (None, None)}
    files = [(p, t) for p, (_, t) in wanted.items()]
    got = {r.path: r.own_licence for r in op2.scan(files_df(spark, files).repartition(4), windows=True).collect()}
    assert got == {p: name for p, (name, _) in wanted.items()}


def test_windows_equal_to_brute_force(spark):
    rng = random.Random(5)
    some = [w for _, b in op2.TEMPLATES for w in b.split()]
    texts = [" ".join(rng.choice(some if rng.random() < share else ["a", "b", "the", "of"]) for _ in range(n)) for share in (0.2, 0.9) for n in (1, 3, 8, 40, 90)]
    texts += [" ".join([*rng.sample(some, 20), *b.split()[:-2], *rng.sample(some, 20)]) for _, b in op2.TEMPLATES] + [t for t in TEXTS.values() if t]
    lines = [x for t in texts for x in t.split("\n") if x.strip(" ")]
    df = Counter(t for x in lines for t in set(terms(x)))
    vocabulary = {t for _, b in op2.TEMPLATES for t in terms(b)}
    vec = lambda ts: {t: n * (math.log((len(lines) + 1) / ((df[t] if t in vocabulary else 0) + 1)) + 1) for t, n in Counter(ts).items()}
    cos = lambda v, w: round(sum(x * w.get(t, 0) for t, x in v.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values())), 6) if v else 0
    want = []
    for text in texts:
        found = [(-cos(vec(terms(x)), vec(terms(b))), n) for x in text.split("\n") for n, b in op2.TEMPLATES]
        for n, b in op2.TEMPLATES:
            size, ts = len(terms(b)), terms(text)
            found += [(-cos(vec(ts[i:i + size]), vec(terms(b))), n) for i in range(max(1, len(ts) - size + 1))]
        s, n = min(found)
        want.append((n, -s) if -s >= op2.THRESHOLD else (None, None))
    rows = files_df(spark, [(f"{i}/x", t) for i, t in enumerate(texts)])
    got = {r.file_id: (r.own_licence, r.score) for r in op2.scan(rows, windows=True).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(n is not None for n, _ in want) > 15


def test_windows_keep_the_plan_native(spark):
    plan = op2.own_licences(files_df(spark, list(TEXTS.items())), windows=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_query_uses_windows(spark, tmp_path):
    spark.createDataFrame([(11, "word " * 40 + "Released under the MIT License. " + "word " * 40, "en", "web", 0)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.own_licence for r in QUERIES["op2_license_scan"](spark, str(tmp_path)).collect()] == ["MIT"]
