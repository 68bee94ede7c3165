"""Run registered queries against their oracle SQL: python tests/check_queries.py [sf] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from kickframe.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False, name=None):
        cells = []
        for v in row:
            if v is None or (not isinstance(v, (list, tuple, dict)) and pd.isna(v)):
                cells.append("~")
            elif isinstance(v, bool):
                cells.append(str(v))
            elif isinstance(v, float):
                cells.append(str(int(v)) if v == int(v) else repr(v))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = canon(spark_pdf), canon(duck_pdf)
    if a != b:
        sa, sb = set(a), set(b)
        left, right = sorted(sa - sb), sorted(sb - sa)
        return f"{len(left)} rows differ, cols {sorted(spark_pdf.columns)}\n   spark {left[:2]}\n   duck  {right[:2]}"
    return ""


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def types_of(con, text: str) -> dict[str, str]:
    return {r[0]: r[1] for r in con.execute("DESCRIBE " + text).fetchall()}


SPARK_TO_DUCK = {
    "bigint": {"BIGINT"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"}, "date": {"DATE"},
}


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    qs, sqls = queries(), oracle_sql()
    names = argv[1:] or list(qs)
    names = [n for n in qs if any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in names)] or names
    spark = local_session()
    con = connect(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            pdf = df.toPandas()
            dt = time.time() - t0
            if name in sqls:
                t1 = time.time()
                duck = con.execute(sqls[name]).df()
                msg = compare(pdf, duck)
                kinds = types_of(con, sqls[name])
                odd = [
                    f"{c}: {t} vs {kinds.get(c)}"
                    for c, t in df.dtypes
                    if kinds.get(c) not in SPARK_TO_DUCK.get(t, {kinds.get(c)})
                ]
                if odd and not msg:
                    msg = "types " + "; ".join(odd)
                if len(pdf) == 0:
                    msg = msg or "EMPTY"
                print(f"{'ok ' if not msg else 'BAD'} {name:34s} {len(pdf):7d} rows {dt:6.2f}s duck {time.time()-t1:.2f}s {msg}", flush=True)
            else:
                msg = "" if len(pdf) else "EMPTY"
                print(f"{'-- ' if not msg else 'BAD'} {name:34s} {len(pdf):7d} rows {dt:6.2f}s (no oracle) {msg}", flush=True)
            bad += bool(msg)
        except Exception as exc:  # report and go on
            bad += 1
            print(f"ERR {name:34s} {type(exc).__name__}: {str(exc)[:700]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
