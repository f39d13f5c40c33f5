"""Registry of queries and the SQL text of the views they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VIEWS = {
    "fx_pw": """
SELECT CAST(date_trunc('month', l.l_shipdate) AS DATE) AS REPORT_DATE,
       n.n_name AS BOOK, r.r_name AS BOOK_ATTR6, l.l_linestatus AS BOOK_ATTR7, p.p_brand AS BOOK_ATTR8,
       l.l_returnflag AS USR_VAL4, o.o_orderpriority AS TGROUP1, o.o_orderstatus AS TGROUP2,
       c.c_mktsegment AS SEGMENT, p.p_type AS BUCKET,
       concat('M+', CAST(l.l_linenumber AS VARCHAR(10))) AS HORIZON,
       CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS VOLUME_BL,
       CASE WHEN l.l_linestatus = 'F' THEN l.l_quantity ELSE CAST(0 AS DOUBLE) END AS VOLUME_PK,
       CASE WHEN l.l_linestatus = 'O' THEN l.l_quantity ELSE CAST(0 AS DOUBLE) END AS VOLUME_OFPK,
       CASE WHEN l.l_returnflag = 'R' THEN -l.l_extendedprice ELSE l.l_extendedprice END AS MKT_VAL_BL,
       CASE WHEN l.l_linestatus = 'F' THEN l.l_extendedprice ELSE CAST(0 AS DOUBLE) END AS MKT_VAL_PK,
       CASE WHEN l.l_linestatus = 'O' THEN l.l_extendedprice ELSE CAST(0 AS DOUBLE) END AS MKT_VAL_OFPK,
       l.l_extendedprice * (1 - l.l_discount) AS TRD_VAL_BL,
       CASE WHEN l.l_linestatus = 'F' THEN l.l_extendedprice * (1 - l.l_discount) ELSE CAST(0 AS DOUBLE) END AS TRD_VAL_PK,
       CASE WHEN l.l_linestatus = 'O' THEN l.l_extendedprice * (1 - l.l_discount) ELSE CAST(0 AS DOUBLE) END AS TRD_VAL_OFPK
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "fx_co2": """
SELECT CAST(date_trunc('month', l.l_shipdate) AS DATE) AS REPORT_DATE,
       p.p_brand AS BOOK, c.c_mktsegment AS SEGMENT, o.o_orderpriority AS TGROUP1,
       l.l_quantity AS VOLUME, l.l_extendedprice AS MKTVAL,
       l.l_extendedprice * (1 - l.l_discount) AS TRDVAL, p.p_retailprice AS TRDPRC
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey""",
    "fx_ng": """
SELECT CAST(date_trunc('month', l.l_shipdate) AS DATE) AS REPORT_DATE,
       p.p_brand AS BOOK, c.c_mktsegment AS SEGMENT, o.o_orderpriority AS TGROUP1,
       concat('M+', CAST(l.l_linenumber AS VARCHAR(10))) AS HORIZON,
       l.l_quantity AS VOLUME, l.l_quantity * l.l_linenumber AS VOLUME_TOTAL,
       CASE WHEN l.l_linestatus = 'F' THEN l.l_quantity ELSE CAST(0 AS DOUBLE) END AS QTY_PHY,
       l.l_extendedprice AS MKT_VAL,
       CASE WHEN l.l_linestatus = 'O' THEN l.l_quantity ELSE CAST(0 AS DOUBLE) END AS QTY_FIN,
       l.l_extendedprice * (1 - l.l_discount) AS TRD_VAL
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey""",
    "fx_files": """
SELECT o_orderkey AS file_id,
       concat('NOP_', CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'CO2' WHEN 1 THEN 'NG' WHEN 2 THEN 'PW' ELSE 'XX' END,
              '_', CAST(o_orderkey AS VARCHAR(20)), '.csv') AS file_name,
       CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'CO2' WHEN 1 THEN 'NG' WHEN 2 THEN 'PW' ELSE 'XX' END AS category,
       CAST(o_orderdate AS DATE) AS report_date,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_processed,
       o_orderdate AS uploaded_at
FROM orders""",
    "fx_agents": """
SELECT CAST(n_nationkey AS BIGINT) AS agent_id, n_name AS name,
       CASE n_nationkey % 5 WHEN 0 THEN 'CO2' WHEN 1 THEN 'NG' WHEN 2 THEN 'PW' WHEN 3 THEN 'misc' ELSE NULL END AS s3_folder,
       CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 END AS is_active
FROM nation""",
    "fx_logs": """
SELECT event_id AS log_id, CAST(user_id % 20 AS BIGINT) AS agent_id, event_type AS query, props AS answer,
       CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'CO2' WHEN 1 THEN 'NG' ELSE 'PW' END AS category,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS user_feedback,
       CASE WHEN event_type = 'error' THEN concat('issue_', CAST(user_id % 4 AS VARCHAR(5))) ELSE NULL END AS feedback_comment,
       value AS latency, ts AS created_at
FROM events""",
    "fx_feedback": """
SELECT d.doc_id AS id, d.text AS query,
       CASE WHEN l.quality = 0 THEN 0 ELSE 1 END AS user_feedback,
       CASE WHEN l.quality = 0 THEN concat('comment_', CAST(d.doc_id AS VARCHAR(20))) ELSE NULL END AS feedback_comment
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_prompts": """
SELECT o_orderkey AS prompt_id,
       concat(CASE CAST(o_orderkey % 6 AS INT)
                WHEN 0 THEN 'Show volume bl' WHEN 1 THEN 'plot AVG_MKT_VAL_BL'
                WHEN 2 THEN 'What is the net open position' WHEN 3 THEN 'open position value in dollar'
                WHEN 4 THEN 'Compare trd val pk and max volume pk' ELSE 'Any news' END,
              ' on ',
              CASE CAST(o_orderkey % 5 AS INT)
                WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
                WHEN 2 THEN strftime(o_orderdate, '%-d/%-m/%y') WHEN 3 THEN strftime(o_orderdate, '%-d%b%Y')
                ELSE '99-99-2024 or 31/02/2024' END) AS prompt
FROM orders""",
}


def with_views(body: str) -> str:
    """Put the views a checking SQL mentions in front of it as CTEs."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", body)]
    text = body.strip()
    ctes = [f"{name} AS ({VIEWS[name]}\n)" for name in used]
    if not ctes:
        return text
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + text[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + text


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name`, with the SQL that must give the same rows."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = with_views(sql)
        return build

    return add


def exact_sum(column: str) -> str:
    """Sum of a money or volume column as a decimal of eight places, null without input."""
    return f"SUM(CAST({column} AS DECIMAL(28,8)))"


def as_double(decimal: str) -> str:
    """The nearest double: the detour over text keeps all digits."""
    return f"CAST(CAST({decimal} AS VARCHAR) AS DOUBLE)"


def dsum(column: str) -> str:
    """Exact sum, 0 when there is nothing to add."""
    return f"COALESCE({as_double(exact_sum(column))}, 0)"


def dsum_null(column: str) -> str:
    return as_double(exact_sum(column))


def round2(expr: str, places: int = 2) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,6)), {places}) AS DOUBLE)"
