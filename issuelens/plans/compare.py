"""Order-insensitive comparison of a query result with its DuckDB oracle."""

from __future__ import annotations

import math

from ..sources.tables import TABLES


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


_DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                  "BOOLEAN": "boolean", "FLOAT": "float", "SMALLINT": "smallint",
                  "TINYINT": "tinyint", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def type_differences(spark_df, con, sql: str) -> list[str]:
    """Columns whose Spark type differs from the oracle's (DuckDB type names mapped)."""
    rel = con.sql(sql)
    duck = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    out = []
    for f in spark_df.schema.fields:
        d = duck.get(f.name)
        if d is None:
            continue
        want = _DUCK_TO_SPARK.get(d, d.lower())
        if want != f.dataType.simpleString():
            out.append(f"{f.name}: spark {f.dataType.simpleString()} oracle {d}")
    return out


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between a Spark frame and the oracle's result (empty when equal)."""
    types = type_differences(spark_df, con, sql)
    srows, scols = spark_df.collect(), spark_df.columns
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    msgs = [f"types {'; '.join(types)}"] if types else []
    if sorted(scols) != sorted(dcols):
        msgs.append(f"columns spark={scols} oracle={dcols}")
    if len(srows) != len(drows):
        msgs.append(f"rows spark={len(srows)} oracle={len(drows)}")
    if not msgs:
        a, b = canonical(scols, srows), canonical(dcols, drows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            msgs.append(f"values differ, e.g. {str(diff)[:500]}")
    return msgs
