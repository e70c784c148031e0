"""Projections of the driver's tables onto the shapes of the domain.

Each is SQL that reads the same on Spark and in the oracle: ``{table}`` names a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import Tables, dealt

VIEWS = {
    "events_view": """
        SELECT o_orderkey AS id, o_custkey AS series_id, c_name AS name, CAST(o_orderdate AS DATE) AS start_date,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS end_date, CAST(year(o_orderdate) AS INT) AS year, n_name AS country,
               CASE o_orderstatus WHEN 'F' THEN 'past' WHEN 'O' THEN 'listed' ELSE 'historical' END AS lifecycle_status, o_orderpriority AS source,
               CASE o_orderkey % 10 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'month' ELSE 'day' END AS date_precision
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "parts_view": """
        SELECT p_partkey AS id, p_name AS name, lower(p_name) AS name_norm, p_brand AS alias, p_type AS kind, p_size AS size FROM {part}""",
    "marks_view": """
        SELECT l_orderkey AS event_key, CAST(l_linenumber AS INT) AS line, o_custkey AS competitor, CAST(year(o_orderdate) AS INT) AS year, CAST(o_orderdate AS DATE) AS start_date,
               CASE l_linestatus WHEN 'O' THEN 'leader' ELSE 'follower' END AS role,
               CASE WHEN l_linenumber <= 3 THEN 'prelims' WHEN l_linenumber <= 5 THEN 'quarters' WHEN l_linenumber = 6 THEN 'semis' ELSE 'finals' END AS round,
               s_name AS judge, CASE l_returnflag WHEN 'R' THEN 'Y' WHEN 'N' THEN 'N' ELSE concat('A', CAST(1 + l_suppkey % 3 AS STRING)) END AS mark,
               CAST(1 + l_partkey % 12 AS INT) AS place, l_suppkey % 2 = 0 AS advanced
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "awards_view": """
        SELECT user_id AS competitor, event_id AS event_key, event_type AS division, CASE event_id % 2 WHEN 0 THEN 'leader' ELSE 'follower' END AS role,
               CAST(floor(value) AS BIGINT) % 16 AS points FROM {events}""",
}


#: Keys on which a view's large tables meet; everything that queries group by comes after, within the tasks of this join or by another shuffle.
_MEET = {"marks_view": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}


def view(t: Tables, name: str) -> DataFrame:
    used = {u: t[u] for u in sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))}
    meet = _MEET.get(name, {})
    rows = max((used[u].count() for u in meet), default=0)  # from the files' footers
    return t.spark.sql(VIEWS[name], **{u: dealt(df, rows, meet[u]) if u in meet else df for u, df in used.items()})


def with_views(sql: str) -> str:
    """An oracle's SQL with the views it names put in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = [f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v])})" for v in used]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join([*heads, body[len("WITH RECURSIVE ") :]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*heads, body[5:]])
    return ("WITH " + ", ".join(heads) + " " if heads else "") + body


class Registry:
    """Queries by name, each with its SQL where SQL can say it."""

    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = lambda spark, path: fn(_tables(spark, path))
            if sql:
                self.oracle[name] = with_views(sql)
            return fn

        return add


def _tables(spark: SparkSession, path: str) -> Tables:
    from .session import package_on_workers

    package_on_workers(spark)
    return Tables(spark, path)
