"""Files parsed in pieces give the rows of the whole file, wherever the cuts fall."""

import random

import pytest
from pyspark.sql import functions as F

from fleetcat.operators import scan
from fleetcat.operators import segment as seg

KEYS = ["file"]


def lines_df(spark, files):
    return spark.createDataFrame([(f, i, x) for f, text in files.items() for i, x in enumerate(text)], "file string, line_no int, line string")


TABLE_LINES = ["table T", "\tmeasure 'a' =", "\tmeasure b = 1", "\t\t\t```", "\t\t\t1 + 1", "\t\t```", "```", "\t\tformatString: 0", "\tcolumn c", "\tcolumn d = 2", "\t\tdataType: int64",
               "\t\tsourceColumn: x", "\tpartition p = m", "\t\tmode: import", "\t\tsource =", "\t\tsource = x", "\t\t\t\tlet", "", "\t", "\thierarchy h", "\t\tlevel l",
               "\t\t\tcolumn: q", "\tcalculationGroup", "\t\tcolumn: g", "\t\tcalculationItem i = 1", "\t\tcalculationItem 'j'", "\t\t\texpression = 3", "\t\t\texpression =",
               "\t\t\t\t```", "\t\t\t\tx", "\t\t\tordinal = 2", "\tannotation z", "other", "\t\tisKey: true"]
LEVEL_LINES = ["\thierarchy h", "\t\tlevel l", "\t\tlevel 'm n'", "\t\t\tcolumn: q", "\tmeasure b = 1", "", "other", "\tmeasure a =", "\t\t\t```"]
EXPRESSION_LINES = ["expression a = 1", "expression 'b' =", "\texpression c =", "\t\t```", "\t\tlet x = 1", "```", "\t\tIsParameterQuery=true", "\tlineageTag: t", "other", "", "\t\t\t```"]
RELATION_LINES = ["relationship r", "relationship", "\tfromColumn: A.b", "\ttoColumn: 'C d'.'e'", "\ttoCardinality: many", "", "other", "\tcrossFilteringBehavior: bothDirections", "```"]


def files(pool, seed, n=6):
    rng = random.Random(seed)
    out = {f"f{k}": [rng.choice(pool) for _ in range(rng.choice([1, 7, 40, 90]))] for k in range(n)}
    out["fences"] = [rng.choice(["\tmeasure a =", "```", "\t\t```", "\tmeasure b = 1", "expression x =", "\t\t\t1"]) for _ in range(120)]
    out[None] = [pool[0], pool[1]]
    return out


PARSERS = [("table", scan.of_blocks(seg.columns), TABLE_LINES), ("table", scan.of_blocks(seg.measures), TABLE_LINES),
           ("table", scan.of_blocks(seg.partitions), TABLE_LINES), ("table", scan.of_blocks(seg.calculation_items), TABLE_LINES),
           ("table", scan.of_blocks(seg.hierarchy_levels), LEVEL_LINES), ("relationships", seg.relationships, RELATION_LINES),
           ("expressions", seg.shared_expressions, EXPRESSION_LINES)]


@pytest.mark.parametrize("kind, parse, pool", PARSERS, ids=["T4", "T5", "T6", "T7", "T8", "T9", "T10"])
def test_pieces_equal_the_whole_file(spark, kind, parse, pool):
    lines = lines_df(spark, files(pool, len(pool))).where("file is not null").cache()
    want = sorted(map(str, parse(lines, KEYS).collect()))
    assert want
    for segment_lines, piece_lines in ((1, 1), (7, 5)):
        got = scan.parse_in_pieces(lines, KEYS, kind, parse, segment_lines, piece_lines)
        assert sorted(map(str, got.collect())) == want


def test_pieces_are_whole_blocks_and_many(spark):
    text = [x for k in range(400) for x in (f"\tmeasure m{k} =", "\t\t\t```", "\tmeasure not one = 1", "\t\t\t```", "")]
    got = scan.with_pieces(lines_df(spark, {"f": ["table T", *text]}), KEYS, "table", 64, 100)
    rows = got.collect()
    assert len(rows) == len(text) + 1 and len({r.piece for r in rows}) == 20
    heads = {r.line_no for r in rows if r.line.startswith("\tmeasure m")}
    first = {}
    for r in rows:
        first[r.piece] = min(first.get(r.piece, 1 << 60), r.line_no)
    assert all(v in heads or v == 0 for v in first.values())


def test_empty_lines_table(spark):
    none = lines_df(spark, {"f": ["x"]}).where("false")
    for kind, parse, _ in PARSERS:
        assert scan.parse_in_pieces(none, KEYS, kind, parse).collect() == []


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_file_is_read_by_many_tasks(spark, tmp_path, end):
    rng = random.Random(3)
    text = [rng.choice(TABLE_LINES) + rng.choice(["", " é", " x" * 50]) for _ in range(5000)]
    (tmp_path / "one.tmdl").write_bytes(end.join(text).encode())
    (tmp_path / "two.tmdl").write_bytes((end.join(text[:7]) + end).encode())
    (tmp_path / "empty.tmdl").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        got = scan.scan_large_files(spark, str(tmp_path))
        starts = spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        by_file = {}
        for r in got.orderBy("line_no").collect():
            by_file.setdefault(r.file_path.rsplit("/", 1)[1], []).append((r.line_no, r.line))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert starts > 10
    assert by_file == {"one.tmdl": list(enumerate(text)), "two.tmdl": list(enumerate(text[:7]))}
    whole = seg.lines_of(spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), KEYS)
    assert sorted(r.line for r in whole.collect()) == sorted(r.line for r in got.collect())
