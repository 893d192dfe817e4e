"""The registry of queries, and shared pieces of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The wide matrix of customers and parts.
WIDE = """
x AS (SELECT o_custkey AS cell_id, l_partkey AS gene_id, CAST(sum(l_quantity) AS DOUBLE) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
obs AS (SELECT c_custkey AS cell_id, c_mktsegment AS grp, c_nationkey AS batch, c_acctbal AS cov FROM customer WHERE c_custkey IN (SELECT cell_id FROM x)),
var AS (SELECT p_partkey AS gene_id, p_brand, p_type, p_size, p_type = 'PROMO' AS flagged FROM part WHERE p_partkey IN (SELECT gene_id FROM x)),
nc AS (SELECT count(*) AS n FROM obs)"""
#: The matrix of customers and brands.
COMPACT = """
x AS (SELECT o_custkey AS cell_id, CAST(substr(p_brand, 7) AS BIGINT) AS gene_id, CAST(sum(l_quantity) AS DOUBLE) AS value
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
obs AS (SELECT c_custkey AS cell_id, c_mktsegment AS grp, c_nationkey AS batch, c_acctbal AS cov FROM customer WHERE c_custkey IN (SELECT cell_id FROM x)),
var AS (SELECT DISTINCT gene_id, 'Brand#' || gene_id AS var_name FROM x),
nc AS (SELECT count(*) AS n FROM obs)"""
#: x scaled to median totals, with its logarithm.
NORMED = """
tot AS (SELECT cell_id, coalesce(sum(value), 0) AS total FROM obs LEFT JOIN x USING (cell_id) GROUP BY 1),
tgt AS (SELECT quantile_cont(total, 0.5) AS target FROM tot),
norm AS (SELECT cell_id, gene_id, CASE WHEN total = 0 THEN value ELSE value * target / total END AS value FROM x JOIN tot USING (cell_id) CROSS JOIN tgt),
lx AS (SELECT cell_id, gene_id, ln(1 + value) AS value FROM norm)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that states its result."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql.strip()
        return f

    return add


def with_(*parts: str, recursive: bool = False) -> str:
    """A WITH query of CTE texts; the last part is the SELECT."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",".join(p.strip().rstrip(",") for p in parts[:-1]) + "\n" + parts[-1].strip()


def r(column: str, digits: int = 6, alias: str | None = None):
    """A rounded column without a negative zero; NaN becomes null."""
    c = F.col(column)
    return F.when(F.isnan(c), F.lit(None)).otherwise(F.round(c, digits) + 0.0).alias(alias or column)


def rs(expr: str, alias: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"CASE WHEN isnan(CAST({expr} AS DOUBLE)) THEN NULL ELSE round(CAST({expr} AS DOUBLE), {digits}) + 0.0 END AS {alias}"
