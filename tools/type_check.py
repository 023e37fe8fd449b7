"""Compare Spark and DuckDB result column types (normalised) for every query."""
import sys
sys.path.insert(0, __import__('os').path.dirname(__import__('os').path.dirname(__import__('os').path.abspath(__file__))))
import duckdb
from fleetcat.plans.registry import ORACLES, QUERIES, load_all
from fleetcat.session import DRIVER_TABLES, build_session
load_all()
spark = build_session()
con = duckdb.connect()
sf = '/root/testdata/sf0.01'
for t in DRIVER_TABLES:
    con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
SP = {'int': 'int32', 'bigint': 'int64', 'double': 'float64', 'string': 'str', 'boolean': 'bool', 'date': 'date',
      'smallint': 'int16', 'float': 'float32', 'timestamp_ntz': 'ts', 'timestamp': 'ts'}
DK = {'INTEGER': 'int32', 'BIGINT': 'int64', 'DOUBLE': 'float64', 'VARCHAR': 'str', 'BOOLEAN': 'bool', 'DATE': 'date',
      'SMALLINT': 'int16', 'FLOAT': 'float32', 'TIMESTAMP': 'ts', 'HUGEINT': 'int128'}
bad = 0
for n, fn in QUERIES.items():
    if n not in ORACLES:
        continue
    sdf = fn(spark, sf)
    st = {f.name: SP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    rel = con.sql(f"select * from ({ORACLES[n]}) limit 0")
    dt = {c: DK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    diff = {c: (st.get(c), dt.get(c)) for c in st if st.get(c) != dt.get(c)}
    if diff:
        bad += 1
        print(n, diff)
print("type mismatches:", bad)
