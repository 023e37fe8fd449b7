"""Layout documents rendered from pages with nested visuals: the rows of the flat catalog tables, and one shuffle."""

import datetime

import pytest

from fleetcat.sources import fixtures
from fleetcat.sources.layout_json import render_layout_docs, render_page_files

COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
DAY = datetime.date(1996, 3, 1)
LINES = [
    (1, 10, 3, 2, 5.0, 10.0, "A", DAY), (1, 11, 4, 1, 5.0, 10.0, "N", DAY), (1, 11, 4, 1, 5.0, 10.0, "N", DAY),
    (1, None, 5, None, 5.0, None, None, None), (2, 51, None, 3, 1.0, 1.0, "A", DAY), (13, 18, 2, 1, None, 2.0, "R", DAY),
    (None, 7, 7, 1, 1.0, 1.0, "A", DAY),
]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nested"))
    types = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate date"
    spark.createDataFrame(LINES, types).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, "P"), (2, "O"), (3, "O"), (None, "P")], "o_orderkey long, o_orderstatus string").write.parquet(f"{path}/orders.parquet")
    return path


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_nested_rows_are_the_flat_rows(spark, sf_dir):
    nested = fixtures.nested_visuals(spark, sf_dir).selectExpr("model_id", "page_id", "inline(visuals)")
    flat = fixtures.fixture(spark, sf_dir, "cat_visuals")
    names = [c for c in flat.columns if c not in ("model_id", "page_id")]
    assert _rows(nested.select("model_id", "page_id", *[f"visual.{c}" for c in names])) == _rows(flat.where("page_id is not null"))
    fields = fixtures.fixture(spark, sf_dir, "cat_visual_fields").where("page_id is not null")
    got = nested.selectExpr("model_id", "page_id", "visual.pos", "visual.type", "inline(fields)")
    assert _rows(got.select(*fields.columns)) == _rows(fields)


@pytest.mark.parametrize("render, exchanges", [(render_layout_docs, 2), (render_page_files, 1)])
def test_rendering_shuffles_compact_rows_once(spark, sf_dir, render, exchanges):
    pages = fixtures.fixture(spark, sf_dir, "cat_pages")
    docs = render(pages, fixtures.nested_visuals(spark, sf_dir))
    plan = docs._jdf.queryExecution().sparkPlan().toString()
    physical = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("collect_list") and "displayName" not in plan.split("collect_list")[-1]
    assert physical.count("Exchange hashpartitioning") <= exchanges
    assert docs.count() == (4 if render is render_layout_docs else 4 + 6)
