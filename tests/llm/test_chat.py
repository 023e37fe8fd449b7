import json

from fleetcat.llm import op9
from fleetcat.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, tool_calls string, tool_call_id string, level string, status string"


def calls(*items):
    return json.dumps([{"id": i, "name": n, "arguments": a if isinstance(a, str) else json.dumps(a)} for i, n, a in items])


TOOLS = {"f": {"type": "object", "required": ["q"], "additionalProperties": False, "properties": {
    "q": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 1, "maximum": 5}, "k": {"enum": ["a", 1]},
    "xs": {"type": "array", "items": {"type": "number"}}}}}


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {(r.conv_id, r.call_id, r.call_turn): r for r in op9.linked_calls(df.repartition(3), TOOLS, every_result=False).collect()}


def test_links_order_and_status(spark):
    rows = [
        (1, 1, "assistant", "", calls(("c", "f", {"q": "{{b}} and {{a}}"}), ("b", "f", {"q": "{{a}}"}), ("a", "f", {"q": "x", "n": 2})), None),
        (1, 2, "tool", "ra", None, "a"), (1, 3, "tool", "rb", None, "b"), (1, 3, "tool", "again", None, "a"), (1, 4, "tool", "rc", None, "c"),
        (1, 5, "assistant", "", calls(("a", "f", {"q": "repeat"}), ("u", "g", {"q": 1}), ("lone", "f", {"q": "{{nowhere}}"})), None), (1, 6, "tool", "ru", None, "u"),
        (2, 1, "assistant", None, calls(("x", "f", {"q": "{{y}}"}), ("y", "f", {"q": "{{x}}"}), ("z", "f", {"q": "{{y}}"})), None),
        (2, 2, "tool", "o", None, "x"), (2, 2, "tool", "o", None, "y"), (2, 2, "tool", "o", None, "z"), (2, 3, "tool", None, None, "ghost"),
        (None, 1, "assistant", "", calls(("a", "f", "not json")), None), (None, 2, "tool", "null conversation", None, "a"),
        (3, 1, "assistant", "plain", None, None), (3, 2, "assistant", "broken", "[{", None), (3, 3, "assistant", "none", "[]", None),
        (4, 1, "assistant", "", calls((None, "f", {"q": "no id"})), None),
    ]
    got = run(spark, rows)
    one = {k[1:]: (r.level, r.position, r.status, r.result_turn) for k, r in got.items() if k[0] == 1}
    # c and b name calls that come after them: one stretch, peeled to a, b, c
    assert one == {("a", 1): (0, 0, "ok", 2), ("b", 1): (1, 1, "ok", 3), ("c", 1): (2, 2, "ok", 4), ("a", 5): (None, 3, "duplicate id", None),
                   ("u", 5): (0, 4, "unknown tool", 6), ("lone", 5): (0, 5, "no result", None)}
    two = {k[1]: (r.status, r.level) for k, r in got.items() if k[0] == 2}
    assert two == {"x": ("cycle", None), "y": ("cycle", None), "z": ("ok", 0), "ghost": ("orphan result", None)}
    n = got[(None, "a", 1)]
    assert n.status == "invalid arguments" and n.errors == ["$: not JSON"] and json.loads(n.record)["result"] == "null conversation"
    assert got[(4, None, 1)].status == "no result"
    assert not [k for k in got if k[0] == 3]
    assert got[(1, "a", 1)].record == '{"arguments":{"n":2,"q":"x"},"id":"a","name":"f","result":"ra"}'


def test_schema_violations():
    bad = op9.violations({"q": "", "n": 9, "k": 2, "xs": [1, "2", True], "z": 0}, TOOLS["f"])
    assert bad == ["$.k: not an allowed value", "$.n: above 5", "$.q: too short", "$.xs[1]: not number", "$.xs[2]: not number", "$.z: unknown"]
    assert op9.violations({"n": 2.0}, TOOLS["f"]) == ["$.q: missing"] and op9.violations({"q": "a", "n": True}, TOOLS["f"]) == ["$.n: not integer"]
    assert op9.violations([], TOOLS["f"]) == ["$: not object"]


def test_canonical_json():
    assert op9.canonical({"b": [1, {"é": None}], "a": "\n\""}) == '{"a":"\\n\\"","b":[1,{"é":null}]}'


def test_a_long_chain_needs_no_rounds(spark):
    rows = [(1, 2 * i, "assistant", "", calls((f"c{i}", "f", {"q": f"{{{{c{i - 1}}}}}" if i else "s"})), None) for i in range(300)]
    got = run(spark, rows)
    assert all(got[(1, f"c{i}", 2 * i)].position == i and got[(1, f"c{i}", 2 * i)].level == 0 for i in range(300))


def test_levels_of_chains_take_log_rounds(spark, monkeypatch):
    """Forward chains, calls with several needs, cycles and what hangs behind them: levels equal a walk in plain Python."""
    import random
    rng = random.Random(11)
    needs = {(1, i): [i + 1] for i in range(300)} | {(1, 300): []}  # one chain, each call names the next
    needs |= {(1, 400 + i): [rng.randrange(301)] for i in range(50)}  # many calls hang on the chain
    needs |= {(2, i): rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3]))) for i in range(80)}
    needs |= {(3, 0): [0], (3, 1): [0], (3, 2): [3], (3, 3): [4], (3, 4): [2], (3, 5): [4], (3, 6): [5, 7], (3, 7): [], (3, 8): [7], (3, 9): [8, 7], (3, 10): [9]}
    level = {}
    for _ in range(len(needs)):
        ready = {k: max([level[k[0], j] + 1 for j in js], default=0) for k, js in needs.items() if k not in level and all((k[0], j) in level for j in js)}
        if not ready:
            break
        level |= ready
    tables = []
    monkeypatch.setattr(op9, "written", lambda df, name, _written=op9.written: (tables.append(name), _written(df, name))[1])
    nodes = spark.createDataFrame([(str(c), str(i)) for c, i in needs], "conv string, call_id string")
    edges = spark.createDataFrame([(str(c), str(i), str(j)) for (c, i), js in needs.items() for j in js], "conv string, call_id string, need string")
    got = op9._peeled(nodes, edges).collect()
    assert {(int(r.conv), int(r.call_id)): r.level for r in got} == {k: level.get(k) for k in needs} and len(got) == len(needs)
    assert tables.count("chains") <= 12
    tables.clear()
    assert {(r.call_id, r.level) for r in op9._peeled(nodes.where("conv = '1'"), edges.where("conv = '1'")).collect()} >= {("0", 300), ("300", 0)}
    assert len(tables) <= 14
    assert op9._peeled(nodes, edges.limit(0)).where("level = 0").count() == len(needs)


def test_order_is_topological_and_cycles_are_found_on_random_references(spark):
    import random
    rng = random.Random(7)
    rows, needs = [], {}
    for conv in range(6):
        for i in range(25):
            refs = [j for j in rng.sample(range(25), rng.choice([0, 1, 2])) if j < i or rng.random() < 0.08]
            needs[conv, i] = refs
            rows.append((conv, i // 2, "assistant", "", calls((f"c{i}", "f", {"q": " ".join(f"{{{{c{j}}}}}" for j in refs) or "x"})), None))
    by_conv = {}
    for conv, turn, role, text, c, t in rows:  # calls of one turn come in one message
        by_conv.setdefault((conv, turn), []).extend(json.loads(c))
    got = run(spark, [(conv, turn, "assistant", "", json.dumps(c), None) for (conv, turn), c in by_conv.items()])
    reach = {}

    def behind(conv, i, seen=()):
        if (conv, i) not in reach:
            out, todo = set(), list(needs[conv, i])
            while todo:
                j = todo.pop()
                if j not in out:
                    out.add(j)
                    todo += needs[conv, j]
            reach[conv, i] = out
        return reach[conv, i]

    place = {(k[0], int(k[1][1:])): r for k, r in got.items()}
    assert sorted(r.position for k, r in place.items() if k[0] == 0) == list(range(25))
    stuck = {k for k, r in place.items() if r.status == "cycle"}
    for (conv, i), r in place.items():
        if i in behind(conv, i):
            assert (conv, i) in stuck
        if (conv, i) in stuck:  # on a cycle, or behind one
            assert any(j in behind(conv, j) for j in [i, *behind(conv, i)])
        else:
            assert all(place[conv, j].position < r.position for j in needs[conv, i] if (conv, j) not in stuck)


def test_no_rows(spark):
    assert run(spark, [(1, 1, "user", "hi", None, None)]) == {}


def test_every_result_has_a_row(spark):
    rows = [(1, 1, "assistant", "", calls(("a", "f", {"q": "x"}), ("b", "f", {"q": "y"})), None)]
    rows += [(1, 2 + i % 50, "tool", f"a{i}", None, "a") for i in range(150)] + [(1, 2, "tool", "same", None, "b")] * 3
    rows += [(1, 9, "tool", f"g{i}", None, "ghost") for i in range(3)] + [(1, 9, "tool", f"n{i}", None, None) for i in range(2)]
    rows += [(None, 2, "tool", "no conversation", None, None), (1, 3, "user", "no result", None, None), (2, 1, "user", "r", None, "a"), (2, None, "user", None, None, "a")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = op9.linked_calls(df, TOOLS).collect()
    texts = lambda conv, status: sorted(json.loads(r.record)["result"] or "" for r in got if r.conv_id == conv and r.status == status)
    assert texts(1, "ok") == ["a0", "same"] and texts(1, "orphan result") == ["g0", "g1", "g2", "n0", "n1"]
    assert texts(1, "duplicate result") == sorted([f"a{i}" for i in range(1, 150)] + ["same"] * 2)
    assert texts(None, "orphan result") == ["no conversation"] and texts(2, "orphan result") == ["", "r"]
    one = sorted((r.position, r.status) for r in got if r.conv_id == 1)
    assert [p for p, _ in one] == list(range(len(one))) and [s for _, s in one] == ["ok"] * 2 + ["orphan result"] * 5 + ["duplicate result"] * 151
    assert {r.level for r in got if "result" in r.status} == {None} and {r.call_turn for r in got if "result" in r.status} == {None}
    fewer = op9.linked_calls(df, TOOLS, every_result=False).collect()
    assert sorted(map(str, fewer)) == sorted(str(r) for r in got if r.status != "duplicate result")


def test_the_query_keeps_repeated_turns(spark, tmp_path):
    rows = [(1, 1, "assistant", "question"), (1, 2, "user", "first"), (1, 2, "user", "second"), (None, 2, "user", "nobody's")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op9_chat_tool_linking"](spark, str(tmp_path)).collect()
    assert sorted((r.status, json.loads(r.record)["result"]) for r in got) == [("duplicate result", "second"), ("ok", "first"), ("orphan result", "nobody's")]


def test_arguments_of_any_kind(spark):
    many = "7" * 400
    cases = {
        "digits": ('{"q": "x", "n": %s}' % many, [], '{"n":%s,"q":"x"}' % many), "surrogate": ('{"q": "a\\ud83d"}', [], '{"q":"a\\ud83d"}'),
        "pair": ('{"q": "\\ud83d\\ude00"}', [], '{"q":"\U0001f600"}'), "nan": ('{"q": NaN}', ["$: not JSON"], None), "infinity": ("[-Infinity]", ["$: not JSON"], None),
        "large": ('{"q": 1e400}', ["$: not JSON"], None), "twice": ('{"q": "a", "q": "b", "in": {"z": 1, "z": 2}}', ["$: repeated key q", "$: repeated key z"], None),
        "longest": ("9" * 5000, ["$: not JSON"], None), "deep": ("[" * 100_000, ["$: not JSON"], None), "key": ('{"\\udc00": 1}', [], '{"\\udc00":1}')}
    tools = {"f": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}}}}
    rows = [(1, i, "assistant", "", calls_raw(name, text), None) for i, (name, (text, _, _)) in enumerate(cases.items())]
    rows.append((1, 99, "tool", "r", None, "digits"))
    got = {r.call_id: r for r in op9.linked_calls(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), tools).collect()}
    for name, (text, errors, body) in cases.items():
        assert got[name].errors == errors, name
        json.loads(got[name].record)
        if body:
            assert f'"arguments":{body},' in got[name].record
        elif errors == ["$: not JSON"]:
            assert json.loads(got[name].record)["arguments"] == text
    assert got["digits"].status == "ok" and got["nan"].status == "no result"


def calls_raw(name, arguments):
    return json.dumps([{"id": name, "name": "f", "arguments": arguments}])
