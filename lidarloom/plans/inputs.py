"""The given tables re-read as sensor tables, for Spark and, as SQL text, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Spark and DuckDB differ in how they count microseconds and pick from a list.
DIALECT = {
    "spark": {"us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({0} as timestamp_ntz))", "item": "cast(element_at({0}, {1}) as double)"},
    "duckdb": {"us": "epoch_us({0})", "item": "cast({0}[{1}] as double)"},
}

TEXT = {
    "points": """SELECT l_suppkey % 8 AS drive_id, l_suppkey AS scan_id, l_quantity - 25.5e0 AS x,
        (l_extendedprice - 50000e0) / 2000e0 AS y, l_discount * 100e0 - 5e0 AS z, l_tax * 100e0 AS intensity FROM lineitem""",
    "imu": """SELECT user_id AS drive_id, event_id, event_type, {us:ts} * 1000 AS stamp_ns,
        (event_id % 7 - 3) / 100e0 AS wx, (event_id % 11 - 5) / 100e0 AS wy, (event_id % 13 - 6) / 100e0 AS wz,
        (value - 50e0) / 50e0 AS ax, (event_id % 17 - 8) / 10e0 AS ay, 9.80665e0 + (event_id % 5 - 2) / 100e0 AS az FROM events""",
    "stamps": """SELECT user_id % 10 AS drive_id, user_id AS scan_id, event_id AS point_id,
        1700000000000000000 AS scan_stamp_ns, {us:ts} * 1000 AS stamp_ns FROM events""",
    "cloud": """SELECT 0 AS drive_id, label AS scan_id, vec_id AS point_id, {item:embedding,1} * 10e0 AS x,
        {item:embedding,2} * 10e0 AS y, {item:embedding,3} * 10e0 AS z FROM embeddings""",
    "poses": """SELECT o_custkey % 50 AS drive_id, o_orderkey AS pose_id, {us:o_orderdate} * 1000 AS stamp_ns,
        (o_orderkey % 97) / 10e0 AS px, (o_custkey % 53) / 10e0 AS py, 0e0 AS pz FROM orders""",
}


def text(name: str, dialect: str) -> str:
    """SQL of one sensor table in one dialect."""
    out = TEXT[name]
    for kind, form in DIALECT[dialect].items():
        while (at := out.find("{" + kind + ":")) >= 0:
            end = out.index("}", at)
            out = out[:at] + form.format(*out[at + len(kind) + 2 : end].split(",")) + out[end + 1 :]
    return out


TABLES = {"points": "lineitem", "imu": "events", "stamps": "events", "cloud": "embeddings", "poses": "orders"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = TABLES[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    head, tail = text(name, "spark").rsplit(" FROM ", 1)
    assert tail.strip() == table
    return source.selectExpr(*_columns(head.removeprefix("SELECT ")))


def _columns(head: str) -> list[str]:
    """A select list cut at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(head):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(head[start:i].strip())
            start = i + 1
    return [*out, head[start:].strip()]


def oracle(query: str) -> str:
    """A query with a WITH clause for each sensor table that it names."""
    used = [n for n in TEXT if f" {n}" in f" {query}" and any(f"{k} {n}" in query for k in ("FROM", "JOIN", "from", "join"))]
    ctes = ", ".join(f"{n} AS ({text(n, 'duckdb')})" for n in used)
    q = query.strip()
    if q.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {q[len('WITH RECURSIVE'):]}"
    if q.upper().startswith("WITH"):
        return f"WITH {ctes}, {q[len('WITH'):]}"
    return f"WITH {ctes} {q}" if ctes else q
