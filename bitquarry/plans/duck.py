"""Text of DuckDB SQL for the same formulas and tables, for comparison."""

from __future__ import annotations

import math

PI2 = repr(math.log2(math.pi))


def lg2(x: str) -> str:
    return f"(lgamma(CAST({x} AS DOUBLE)) / ln(2))"


def col(t: str, n: str) -> str:
    return f"({PI2} + {lg2(f'{n} + 1')} - {lg2(f'{t} + 0.5')} - {lg2(f'{n} - {t} + 0.5')})"


def kt(c: str, n: str, d: str) -> str:
    return f"(-log2(({c} + 0.5) / ({n} + {d} / 2.0)))"


def star(x: str) -> str:
    v, out = f"CAST({x} AS DOUBLE)", []
    for _ in range(6):
        v = f"(CASE WHEN {v} > 1 THEN log2({v}) END)"
        out.append(f"coalesce(greatest({v}, 0), 0)")
    return "(" + " + ".join(out) + ")"


def universal(x: str) -> str:
    return f"({star(x)} + 1.5165)"


def choose(n: str, k: str) -> str:
    return f"({lg2(f'{n} + 1')} - {lg2(f'{k} + 1')} - {lg2(f'{n} - {k} + 1')})"


def support(k: str, a: str) -> str:
    return f"({universal(k)} + {choose(a, k)})"


def term(c: str) -> str:
    return f"({math.log2(math.pi) / 2!r} - {lg2(f'{c} + 0.5')})"


def naming(inv: str) -> str:
    return f"log2({inv} + 1)"


def ktblock(s: str, n: str, d: str) -> str:
    return f"({lg2(f'{n} + {d} / 2.0')} - {lg2(f'{d} / 2.0')} + {s})"


def vblock(s: str, n: str, u: str, name: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN {col(u, n)} + {ktblock(s, f'({n} - {u})', u)} + {u} * {name} ELSE 0 END)"


def blockcost(c: str, n: str, u: str, name: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN {name} WHEN {c} = 0 THEN {kt(u, n, '2')} + {name} ELSE {kt(f'({n} - {u})', n, '2')} + {kt(c, n, f'greatest({u}, 1)')} END)"


def price(t: str, k: str, n: str, nodes: str, e: str, a: str) -> str:
    count = f"(CASE WHEN {nodes} > 0 THEN {universal(f'({nodes} + 1)')} - {universal(f'greatest({nodes}, 1)')} ELSE {universal('1')} END + log2({nodes} + 1))"
    return f"({kt(e, f'({n} - 1)', '2')} + 2 + {col(t, n)} + {support(k, a)} + {count})"


def _cells(name: str, rid: str, cols: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST({rid} AS BIGINT) AS rec_id, '{k}' AS key, CAST({v} AS VARCHAR) AS value FROM {source} WHERE {v} IS NOT NULL" for k, v in cols.items())


ORDERS = _cells("orders", "o_orderkey", {"prio": "o_orderpriority", "status": "o_orderstatus", "year": "year(o_orderdate)"}, "orders")
LINEITEM = _cells("lineitem", "l_orderkey * 10 + l_linenumber", {"linestatus": "l_linestatus", "qty_band": "CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END", "returnflag": "l_returnflag", "ship_year": "year(l_shipdate)"}, "lineitem")
EVENTS = _cells("events", "event_id", {"event_type": "event_type", "hour": "hour(ts)", "k": "json_extract_string(props, '$.k')", "weekday": "dayofweek(ts) + 1"}, "events")
CUSTOMER = _cells("customer", "c_custkey", {"nation": "n_name", "region": "r_name", "segment": "c_mktsegment"}, "(customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)")
SUPPLIER = _cells("supplier", "s_suppkey", {"nation": "n_name", "region": "r_name"}, "(supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)")
PART = _cells("part", "p_partkey", {"brand": "p_brand", "size_band": "CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'medium' ELSE 'large' END", "type": "p_type"}, "part")
MIXED = " UNION ALL ".join(f"SELECT rec_id + {base} AS rec_id, key, value, '{name}' AS truth FROM ({sql})" for name, base, sql in (("orders", 0, ORDERS), ("part", 10_000_000_000, PART), ("supplier", 20_000_000_000, SUPPLIER), ("customer", 30_000_000_000, CUSTOMER)))

PRIOR = """p AS (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY rec_id) - 1 AS c, row_number() OVER (PARTITION BY key ORDER BY rec_id) - 1 AS n FROM cells),
q AS (SELECT *, coalesce(sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM p)"""

PAIRS = """kr AS (SELECT DISTINCT rec_id, key FROM cells),
kn AS (SELECT key, count(*) AS n FROM kr GROUP BY key),
pr AS (SELECT a.key AS key_a, b.key AS key_b, count(*) AS both_n FROM kr a JOIN kr b ON a.rec_id = b.rec_id AND a.key < b.key GROUP BY 1, 2),
kv AS (SELECT DISTINCT key, value FROM cells), ks AS (SELECT key, count(*) AS n FROM kv GROUP BY key),
sh AS (SELECT a.key AS key_a, b.key AS key_b, count(*) AS shared FROM kv a JOIN kv b ON a.value = b.value AND a.key < b.key GROUP BY 1, 2),
shv AS (SELECT sh.*, x.n AS values_a, y.n AS values_b FROM sh JOIN ks x ON x.key = key_a JOIN ks y ON y.key = key_b)"""
