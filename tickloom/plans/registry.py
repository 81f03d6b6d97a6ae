"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the roles that :mod:`tickloom.sources.testdata` builds.
ROLES = {
    "t": "t AS (SELECT event_type AS symbol, epoch_us(ts) AS us, event_id AS seq, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume FROM events)",
    "b": "b AS (SELECT symbol, ((us // 3600000000) + 1) * 3600 AS t, arg_min(price, us) AS open, max(price) AS high, min(price) AS low, arg_max(price, us) AS close, sum(volume)::BIGINT AS volume, sum(price * volume) AS dollars, count(*) AS n FROM t GROUP BY ALL)",
    "d": "d AS (SELECT *, dollar_total / volume AS vwap FROM (SELECT l_suppkey AS symbol, epoch_us(l_shipdate) // 86400000000 AS day, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high, sum(l_quantity) AS volume, sum(l_extendedprice) AS dollar_total FROM lineitem GROUP BY ALL))",
    "s": "s AS (SELECT s_suppkey AS symbol, s_name AS name, n_name AS industry, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
}


def normal_sql(x: str) -> str:
    """DuckDB: the standard normal distribution function, by its series of positive terms."""
    terms = f"list_sum(list_transform(range(151), lambda k: exp((2 * k + 1) * ln(abs({x})) - (lgamma(2 * k + 2) - lgamma(k + 1) - k * ln(2)))))"
    return f"(CASE WHEN {x} = 0 THEN 0.5 WHEN abs({x}) > 9 THEN CASE WHEN {x} > 0 THEN 1 ELSE 0 END ELSE 0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {terms} END)"


def query(name: str, sql: str | None = None, roles: str = "", recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query; ``roles`` names the expressions that precede ``sql`` (which may start with more of them)."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            # A text after "|" is the final SELECT; before it stand further table expressions.
            own, _, last = sql.rpartition("|||")
            parts = [ROLES[r] for r in roles] + ([own.strip().rstrip(",")] if own.strip() else [])
            SQL[name] = ("WITH " + ("RECURSIVE " if recursive else "") + ", ".join(parts) + " " if parts else "") + last.strip()
        return f

    return keep
