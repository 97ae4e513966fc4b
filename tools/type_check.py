"""Compare column types of each Spark query with its DuckDB oracle (developer tool)."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from churnscope.plans.registry import load_all  # noqa: E402
from churnscope.session import get_spark  # noqa: E402
from churnscope.sources.tables import DRIVER_TABLES  # noqa: E402

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_spark("local[8]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false"})
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for n, q in load_all().items():
        if not q.sql:
            continue
        st = {f.name: f.dataType.simpleString() for f in q.run(spark, sf).schema.fields}
        rel = con.sql(q.sql)
        dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diffs = [(c, st[c], dt.get(c)) for c in st if TYPES.get(st[c], st[c]) != dt.get(c)]
        if diffs:
            bad += 1
            print(n, diffs)
    print("type mismatches:", bad)


if __name__ == "__main__":
    main()
