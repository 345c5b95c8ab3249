"""List columns whose Spark type differs from the DuckDB oracle's type."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402

from quarry.plans.registry import all_entries  # noqa: E402
from quarry.session import get_spark  # noqa: E402
from quarry.sources.tables import TABLES, table_path  # noqa: E402

MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
       "timestamp_ntz": "TIMESTAMP", "date": "DATE", "smallint": "SMALLINT", "float": "FLOAT"}
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = get_spark()
con = duckdb.connect()
for t in TABLES:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
for k, e in all_entries().items():
    if not e.oracle:
        continue
    df = e.build(spark, sf)
    st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rel = con.sql(e.oracle)
    dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
    bad = []
    for c, s in st.items():
        want = MAP.get(s, s.upper())
        if dt.get(c) != want and not (s.startswith("decimal") and str(dt.get(c)).startswith("DECIMAL")):
            bad.append(f"{c}: spark {s} / duck {dt.get(c)}")
    if bad:
        print(k, "|", "; ".join(bad))
print("done")
