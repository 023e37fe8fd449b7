"""The streaming ingest parses the same measures as the batch scan."""

import uuid

from conftest import rows
from fleetcat.session import ensure_checkpoint_dir
from fleetcat.sources import definitions as defs
from fleetcat.sources.fixtures import catalog
from fleetcat.streaming.definition_feed import _ingest_batch, current_measures, start_measure_ingest


def test_streaming_ingest_matches_batch(spark, sf_small):
    m = catalog(spark, sf_small, "cat_measures")["cat_measures"]
    landing = defs.write_definition_files(defs.table_files(measures=m))
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-test-{uuid.uuid4().hex}"
    q = start_measure_ingest(spark, landing, f"{base}/out", checkpoint=f"{base}/ck", available_now=True)
    q.awaitTermination(300)
    got = current_measures(spark, f"{base}/out")
    want = m.selectExpr("model_id", "table_name as file", "name", "expression")
    assert rows(got, "model_id", "file", "name", "expression") == rows(want, "model_id", "file", "name", "expression")


def test_replayed_batches_and_saved_again_files_do_not_double(spark, tmp_path):
    schema = "model_id long, file string, value string"
    run = _ingest_batch(str(tmp_path / "out"))
    first = spark.createDataFrame([(1, "a", "table a\n\tmeasure x = 1\n\tmeasure y = 2"), (1, "b", "table b\n\tmeasure z = 3")], schema)
    run(first, 0)
    run(first, 0)
    run(spark.createDataFrame([(1, "a", "table a\n\tmeasure x = 10"), (1, "b", "table b")], schema), 1)
    assert rows(current_measures(spark, str(tmp_path / "out")), "file", "name", "expression") == [("a", "x", "10")]
