"""Compare registered queries with their SQL on DuckDB: ``python tests/check_sql.py [sf] [name-part ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "∅"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float) or type(v).__name__ in ("float64", "float32"):
            return repr(float(v))
        if hasattr(v, "tolist"):
            v = v.tolist()
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in pdf.astype(object).itertuples(index=False))


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    got, want = fn(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns}
    off = {c: k for c, k in kinds.items() if k[0] != k[1] and not set(k) <= {"O", "i", "f"} }
    a, b = canon(got), canon(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, first {diff[0]}"
    if off:
        return f"types {off}"
    return None if a else "empty on both sides"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    from cuelattice.session import build_session
    import __spark_entry__ as entry

    spark = build_session("check", 8)
    size = os.environ.get("BLOCK_ROWS")
    if size:
        spark.conf.set("cuelattice.series.blockRows", size)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if parts and not any(name == p or name.startswith(p + "_") for p in parts):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                note = compare(spark, con, sf_dir, fn, sqls[name])
            else:
                note = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as err:  # noqa: BLE001 - report and go on
            note = f"{type(err).__name__}: {str(err)[:700]}"
        bad += note is not None
        print(f"{'ok ' if note is None else 'BAD'} {name} {time.time() - t0:.2f}s {'' if name in sqls else '(rows only)'} {note or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
