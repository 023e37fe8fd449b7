import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from fleetcat.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and "pipeline" not in __spark_entry__.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline_stages(spark):
    from fleetcat.llm import op1, op3, op5, op7, op8
    from fleetcat.session import read_table

    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "mixing", "token output"]
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        rows = docs.collect()
        kept = {r.doc_id for r in rows}
        assert kept <= ids
        if name == "quality classifier":
            scored = op3.score_documents(before, op3.train(before, read_table(spark, SF, "labels"))).collect()
            assert kept == {r.doc_id for r in scored if r.predicted}
        elif name == "near-duplicates":
            assert sorted(kept) == sorted(r.doc_id for r in op8.near_duplicates(before).collect() if r.doc_id == r.component_id)
        elif name == "decontamination":
            assert kept == ids - {r.doc_id for r in op1.contaminated(before, read_table(spark, SF, "benchmark")).collect()}
        else:
            taken = {r.doc_id for r in op7.mix(before).collect() if r.taken or not r.size}
            assert kept == taken
        ids = kept
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.collect())
    full = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, full)) == sorted(map(str, out))
    assert op5.END_ID == 2
