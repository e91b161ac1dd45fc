"""Runs each query beside its SQL: python tests/oracle.py [sf_dir] [name…]. Prints what differs."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings transcripts sweep_metrics corpus corpus_meta bpe_weights gate_samples eval_items mix_targets".split()


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(canon(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, f, sql) -> str | None:
    """None if equal, else what differs."""
    df = f(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, SQL has {len(want[1])}; only here {list(set(got[1]) - set(want[1]))[:2]}, only there {list(set(want[1]) - set(got[1]))[:2]}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from lexmill.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = local_session(), connect(folder)
    q, sql = entry.queries(), entry.oracle_sql()
    for name in names or q:
        began = time.time()
        try:
            said = compare(spark, con, folder, q[name], sql.get(name))
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{'ok  ' if said is None else 'BAD '} {name} {time.time() - began:.1f}s{'' if sql.get(name) else ' (rows only)'} {said or ''}", flush=True)
