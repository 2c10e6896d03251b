"""The derived views again, as DuckDB common table expressions for the side-by-side check."""

from __future__ import annotations

from plumbline.sources.views import NUMERAL_WORDS, TEMPLATES, pieces

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "cells": ((), """
        SELECT concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS period, c_nationkey AS nk,
               o_orderpriority AS metric, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
               count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"""),
    "score": (("cells",), """
        SELECT period, n_name AS entity, nk, h, h / 100.0 AS score,
               concat(period, '-P', lpad(CAST(nk + 1 AS VARCHAR), 2, '0')) AS source
        FROM (SELECT period, nk, CAST((2 * sum(cents) + sum(n) * 100000) // (2 * sum(n) * 100000) AS BIGINT) AS h
              FROM cells GROUP BY 1, 2) JOIN nation ON nk = n_nationkey"""),
    "metric_score": (("cells",), """
        SELECT period, metric, n_name AS entity, (2 * cents + n * 100000) // (2 * n * 100000) AS h,
               ((2 * cents + n * 100000) // (2 * n * 100000)) / 100.0 AS score,
               concat(period, '-P', CAST(nk + 101 AS VARCHAR)) AS source
        FROM cells JOIN nation ON nk = n_nationkey"""),
    "members": ((), """
        SELECT n_name AS entity, r_name AS tier FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "tier": (("score", "members"), """
        SELECT s.period, s.entity, m.tier, s.source, s.h,
               CAST((2 * sum(h) OVER w + count(*) OVER w) // (2 * count(*) OVER w) AS BIGINT) AS avg_h,
               CAST((2 * sum(h) OVER w + count(*) OVER w) // (2 * count(*) OVER w) AS BIGINT) / 100.0 AS tier_avg
        FROM score s JOIN members m ON s.entity = m.entity WINDOW w AS (PARTITION BY s.period, m.tier)"""),
    "period_meta_q": (("cells",), """
        SELECT *, concat(l1_n, '+', l2_n) AS basis_version FROM (
          SELECT period, CAST(sum(n) AS BIGINT) AS sample_n, count(*) AS entity_n, min(k) AS l1_n,
                 count(*) FILTER (k = 5) AS l2_n
          FROM (SELECT period, nk, sum(n) AS n, count(*) AS k FROM cells GROUP BY 1, 2) GROUP BY 1)"""),
    "period_meta_d": ((), """
        SELECT *, concat(l1_n, '+', l2_n) AS basis_version FROM (
          SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS sample_n, count(DISTINCT user_id) AS entity_n,
                 count(DISTINCT event_type) AS l1_n, count(DISTINCT props) AS l2_n FROM events GROUP BY 1)"""),
    "ranked": (("score",), """
        SELECT *, row_number() OVER (PARTITION BY period ORDER BY h DESC, entity) AS row_no,
               rank() OVER (PARTITION BY period ORDER BY h DESC) AS rnk,
               dense_rank() OVER (PARTITION BY period ORDER BY h DESC) AS dense_rnk,
               count(*) OVER (PARTITION BY period) AS entity_n,
               count(*) OVER (PARTITION BY period, h) AS tie_n
        FROM score"""),
    "chunk": ((), """
        SELECT doc_id AS chunk_id, concat(2020 + k // 4, 'Q', k % 4 + 1) AS period, length(text) AS n_chars,
               lang AS page_kind, text
        FROM (SELECT *, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) AS k FROM documents)"""),
    "run": ((), """
        SELECT question_id, category, period, expected_route,
               CASE WHEN k % 11 <> 0 THEN expected_route WHEN expected_route = 'sql' THEN 'search_0' ELSE 'sql' END AS route,
               CASE WHEN k % 7 = 0 THEN concat(m0, ';0.05') WHEN k % 17 = 0 THEN '见原文' ELSE concat(m0, ';', c) END
                 AS expected_answer,
               CASE WHEN k % 5 = 0 THEN concat(m5, ' / ', c) WHEN k % 8 = 0 THEN concat(m0, ' / ', m9)
                    WHEN k % 7 = 0 THEN concat(m0, ' / ', m5) ELSE concat(m0, ' / ', c) END AS answer,
               page AS expected_page,
               CASE WHEN k % 4 = 0 THEN [beside] WHEN k % 6 = 1 THEN [page, '1999Q1-P01'] ELSE [beside, page] END AS sources,
               CASE WHEN k % 10 = 0 THEN 1 WHEN k % 10 = 3 THEN 2 ELSE 0 END AS n_warnings,
               CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS n_trace
        FROM (SELECT *, k AS question_id, o_custkey % 97 AS c,
                     CASE WHEN k % 9 = 0 THEN 'refuse' WHEN k % 9 <= 2 THEN 'search' WHEN k % 9 = 3 THEN 'clarify' ELSE 'sql' END
                       AS expected_route,
                     concat(h // 100, '.', lpad(CAST(h % 100 AS VARCHAR), 2, '0')) AS m0,
                     concat((h + 5) // 100, '.', lpad(CAST((h + 5) % 100 AS VARCHAR), 2, '0')) AS m5,
                     concat((h + 9) // 100, '.', lpad(CAST((h + 9) % 100 AS VARCHAR), 2, '0')) AS m9,
                     concat(period, '-P', lpad(CAST(nk + 1 AS VARCHAR), 2, '0')) AS page,
                     concat(period, '-P', lpad(CAST((nk + 2) % 25 + 1 AS VARCHAR), 2, '0')) AS beside
              FROM (SELECT o_orderkey AS k, o_custkey, o_orderpriority AS category, c_nationkey AS nk,
                           concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS period,
                           CAST(round(o_totalprice * 100) AS BIGINT) // 100000 AS h
                    FROM orders JOIN customer ON o_custkey = c_custkey))"""),
    "trial": ((), """
        SELECT l_orderkey AS question_id, l_linenumber AS position, l_suppkey % 5 + 1 AS pages, l_quantity >= 13 AS ok
        FROM lineitem"""),
    "query": ((), """
        SELECT item_id AS query_id, text AS phrase FROM benchmark"""),
}


def _question() -> str:
    cases = []
    for i, template in enumerate(TEMPLATES):
        filled = ", ".join(x[1:-1] if x.startswith("{") else f"'{x}'" for x in pieces(template))
        cases.append(f"WHEN kind = {i} THEN concat({filled})")
    return f"""SELECT *, CASE {' '.join(cases)} END AS text FROM (
        SELECT o_orderkey AS question_id, CAST(o_orderkey % 25 AS INT) AS kind, n_name AS e, concat('NATION_', (n_nationkey + 7) % 25) AS e2,
               concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS p, concat(year(o_orderdate) - 1, 'Q', quarter(o_orderdate)) AS p2,
               o_orderpriority AS m, r_name AS t, CAST(o_orderkey // 25 % 9 + 1 AS VARCHAR) AS n,
               '{NUMERAL_WORDS}'[o_orderkey // 25 % 9 + 1] AS cn, CAST(n_nationkey AS VARCHAR) AS nk
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


CTES["question"] = ((), _question())


def oracle(views: str, body: str, **extra: str) -> str:
    """``WITH`` the named views (and what they need), then any extra CTEs, then the body."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in CTES[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for view in views.split():
        need(view)
    parts = [f"{name} AS ({CTES[name][1]})" for name in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def half_up(num: str, den: str) -> str:
    """Integer quotient rounded half away from zero, as SQL text; ``den`` is positive."""
    return f"CAST(sign({num}) * ((2 * abs({num}) + ({den})) // (2 * ({den}))) AS BIGINT)"


# The supplied tables: whole (w), fractional (f), time (t), text (s) and array (a) columns.
COLUMNS = {
    "region": "r_regionkey w, r_name s", "nation": "n_nationkey w, n_name s, n_regionkey w", "customer": "c_custkey w, c_name s, c_nationkey w, c_acctbal f, c_mktsegment s",
    "supplier": "s_suppkey w, s_name s, s_nationkey w, s_acctbal f", "part": "p_partkey w, p_name s, p_brand s, p_type s, p_size w, p_retailprice f",
    "orders": "o_orderkey w, o_custkey w, o_orderstatus s, o_totalprice f, o_orderdate t, o_orderpriority s",
    "lineitem": "l_orderkey w, l_partkey w, l_suppkey w, l_linenumber w, l_quantity f, l_extendedprice f, l_discount f, l_tax f, l_returnflag s, l_linestatus s, l_shipdate t",
    "events": "event_id w, ts t, user_id w, event_type s, value f, props s", "documents": "doc_id w, text s, lang s, source s, n_chars w",
    "embeddings": "vec_id w, embedding a, label w", "pages": "page_id w, url s, html s", "benchmark": "item_id w, text s", "labels": "doc_id w, quality w, toxic w",
    "conversations": "conv_id w, turn w, role s, text s",
}


def every_value(leave_out: tuple[str, ...] = ()) -> str:
    """(table, field, value) of every cell as text."""
    number = lambda c: f"regexp_replace(CAST(CAST(round(CAST({c} AS DOUBLE), 6) AS DECIMAL(38, 6)) AS VARCHAR), '\\.?0+$', '')"
    text = {"w": lambda c: f"CAST({c} AS VARCHAR)", "s": lambda c: c, "f": number, "t": lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')", "a": lambda c: number(f"unnest({c})")}
    cells = [f"""SELECT '{table}' AS "table", '{c}' AS field, {text[kind](c)} AS value FROM {table}"""
             for table, columns in COLUMNS.items() if table not in leave_out for c, kind in (x.split() for x in columns.split(", "))]
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(cells) + ") WHERE value IS NOT NULL"
