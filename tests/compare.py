"""Run a query and its SQL side by side: names, types, rows and values."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c.execute(sql).to_arrow_table()


def kind(t) -> str:
    s = str(t)
    if s.startswith("timestamp"):
        return "timestamp"
    return {"large_string": "string"}.get(s, s)


def rows(table, columns):
    def plain(v):
        if isinstance(v, float):
            return "nan" if v != v else round(v, 9) + 0.0
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v

    return sorted((tuple(repr(plain(v)) for v in r) for r in zip(*(table[c].to_pylist() for c in columns), strict=True)), key=str)


def differences(spark_df, sql: str, sf_dir: str) -> list[str]:
    got, want = spark_df.toArrow(), oracle(sql, sf_dir)
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} and {sorted(want.column_names)}"]
    columns = sorted(got.column_names)
    out = [f"{c}: {got.schema.field(c).type} and {want.schema.field(c).type}" for c in columns if kind(got.schema.field(c).type) != kind(want.schema.field(c).type)]
    a, b = rows(got, columns), rows(want, columns)
    if not a and not b:
        out.append("no rows on either side")
    if len(a) != len(b):
        out.append(f"{len(a)} and {len(b)} rows")
    else:
        bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        if bad:
            out.append(f"{len(bad)} of {len(a)} rows differ, as {bad[0]}")
    return out
