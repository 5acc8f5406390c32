"""One query per operator over the test tables, and SQL that another engine can run for each."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import surfaces
from .engine import Engine
from .operators import kernels

#: Tables with columns that the test tables lack: how Spark and how SQL make them.
DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "lines": ("lineitem", {
        "returned": "l_returnflag = 'R'",
        "maybe": "CAST(nullif(l_linenumber, 3) AS BIGINT)",
        "number": "CAST(l_linenumber AS BIGINT)",
        "signed": "CAST(l_linenumber AS BIGINT) * 100 - l_partkey",
        "change": "l_discount * 100 - l_linenumber - 0.5",
        "key_text": "CAST(l_orderkey AS VARCHAR(20))",
        "price_text": "concat(CAST(l_suppkey AS VARCHAR(20)), '.25e1')",
        "flag_text": "CASE WHEN l_returnflag = 'R' THEN 'TRUE' ELSE 'false' END",
    }),
    "toxicity": ("labels", {"bad": "toxic = 1", "good": "quality = 1", "id": "doc_id"}),
}


TABLES = set("region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split())


def frames(spark: SparkSession, sf_dir: str, names: set[str]) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        base, more = DERIVED.get(name, (name, {}))
        df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
        out[name] = df.withColumns({k: F.expr(v.replace("VARCHAR(20)", "STRING")) for k, v in more.items()})
    return out


def used(script: str) -> set[str]:
    return set(re.findall(r"\b(?:FROM|JOIN|TABLE)\s+([a-z]+)\b", script)) & ({*DERIVED} | TABLES)


def ask(script: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last statement of a script over the test tables."""
    engine = Engine.over(spark, frames(spark, sf_dir, used(script)))
    return engine.execute(script)[-1].df


def sql(query: str) -> str:
    """A query for the other engine, with the derived tables it uses."""
    names = [n for n in DERIVED if re.search(rf"\b{n}\b", query)]
    views = [f"{n} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in DERIVED[n][1].items())} FROM {DERIVED[n][0]})" for n in names]
    return (f"WITH {', '.join(views)} " if views else "") + query


#: name: the engine's script, and other SQL where that differs.
QUERIES: dict[str, tuple[str, str | None]] = {
    "flagship": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty, MIN(l_discount) AS min_disc, MAX(l_tax) AS max_tax, AVG(l_quantity) AS mean_qty FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 GROUP BY l_returnflag, l_linestatus HAVING n > 10 ORDER BY l_returnflag, l_linestatus",
        None,
    ),
    "scan_projection": ("SELECT o_orderkey, o_orderstatus AS status, o_totalprice FROM orders", None),
    "filter_comparison": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 30", None),
    "filter_literal_left": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE 30 < l_quantity", None),
    "filter_columns": ("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey < l_orderkey", None),
    "filter_int_float_columns": ("SELECT l_orderkey, number, l_quantity FROM lines WHERE number > l_quantity", None),
    "filter_int_float_literal": ("SELECT l_orderkey, number FROM lines WHERE number <= 2.5 AND number != 1.5", None),
    "filter_and_or_not": ("SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE NOT (l_quantity < 20 OR l_returnflag = 'A') AND l_linestatus = 'O'", None),
    "filter_bool": ("SELECT l_orderkey, returned FROM lines WHERE returned = true", None),
    "filter_between": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", None),
    "filter_not_between": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 2 AND 49", None),
    "filter_in": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", None),
    "filter_in_mixed": ("SELECT l_orderkey, number FROM lines WHERE number IN (1, 2.5, 4.0)", "SELECT l_orderkey, number FROM lines WHERE number IN (1, 4)"),
    "filter_not_in": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", None),
    "like_prefix": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'B%'", "SELECT c_custkey, c_mktsegment FROM customer WHERE starts_with(c_mktsegment, 'B')"),
    "like_suffix": ("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%7'", "SELECT c_custkey, c_name FROM customer WHERE suffix(c_name, '7')"),
    "like_contains": ("SELECT doc_id, lang FROM documents WHERE text LIKE '%tion%'", "SELECT doc_id, lang FROM documents WHERE contains(text, 'tion')"),
    "not_like": ("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT LIKE '%1%'", "SELECT p_partkey, p_brand FROM part WHERE NOT contains(p_brand, '1')"),
    "is_null": ("SELECT l_orderkey, maybe FROM lines WHERE maybe IS NULL", None),
    "is_not_null": ("SELECT l_orderkey, maybe FROM lines WHERE maybe IS NOT NULL", None),
    "null_in_not": ("SELECT l_orderkey, maybe FROM lines WHERE NOT (maybe = 2) OR maybe IS NULL", None),
    "count_star": ("SELECT COUNT(*) AS n, COUNT() AS m FROM lineitem", "SELECT count(*) AS n, count(*) AS m FROM lineitem"),
    "count_column": ("SELECT COUNT(maybe) AS n FROM lines", None),
    "count_if": ("SELECT l_linestatus, countIf(returned) AS n FROM lines GROUP BY l_linestatus", "SELECT l_linestatus, CAST(count_if(returned) AS BIGINT) AS n FROM lines GROUP BY l_linestatus"),
    "sum_int": ("SELECT l_returnflag, SUM(l_partkey) AS s, SUM(maybe) AS t FROM lines GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_partkey) AS BIGINT) AS s, CAST(sum(maybe) AS BIGINT) AS t FROM lines GROUP BY l_returnflag"),
    "sum_float": ("SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag", None),
    "avg_int": ("SELECT l_returnflag, AVG(l_partkey) AS a, AVG(maybe) AS b FROM lines GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_partkey) AS DOUBLE) / count(l_partkey) AS a, CAST(sum(maybe) AS DOUBLE) / count(maybe) AS b FROM lines GROUP BY l_returnflag"),
    "avg_float": ("SELECT l_linestatus, AVG(l_quantity) AS a FROM lineitem GROUP BY l_linestatus", None),
    "min_max_numeric": ("SELECT MIN(l_partkey) AS a, MAX(l_partkey) AS b, MIN(l_extendedprice) AS c, MAX(l_extendedprice) AS d, MIN(maybe) AS e FROM lines", None),
    "min_max_string": ("SELECT c_mktsegment, MIN(c_name) AS a, MAX(c_name) AS b FROM customer GROUP BY c_mktsegment", None),
    "min_max_bool": ("SELECT l_linestatus, MIN(returned) AS a, MAX(returned) AS b FROM lines GROUP BY l_linestatus", None),
    "group_by_one": ("SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority", None),
    "group_by_many": ("SELECT l_returnflag, l_linestatus, number, COUNT(*) AS n FROM lines GROUP BY l_returnflag, l_linestatus, number", None),
    "group_by_null_key": ("SELECT maybe, COUNT(*) AS n FROM lines GROUP BY maybe", None),
    "group_by_cast": ("SELECT CAST(maybe AS Int64) AS k, COUNT(*) AS n FROM lines GROUP BY CAST(maybe AS Int64)", "SELECT maybe AS k, count(*) AS n FROM lines GROUP BY maybe"),
    "grouped_if_null": ("SELECT ifNull(maybe, 0) AS k, isNull(maybe) AS z, isNotNull(maybe) AS y, COUNT(*) AS n FROM lines GROUP BY maybe", "SELECT coalesce(maybe, 0) AS k, maybe IS NULL AS z, maybe IS NOT NULL AS y, count(*) AS n FROM lines GROUP BY maybe"),
    "group_by_page": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20 OFFSET 5", None),
    "having_number": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n >= 12.5", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 13"),
    "having_null": ("SELECT number, SUM(maybe) AS s FROM lines GROUP BY number HAVING s IS NULL", "SELECT number, CAST(sum(maybe) AS BIGINT) AS s FROM lines GROUP BY number HAVING sum(maybe) IS NULL"),
    "having_global": ("SELECT COUNT(*) AS n FROM lineitem HAVING n > 5", "SELECT count(*) AS n FROM lineitem HAVING count(*) > 5"),
    "global_empty_agg": ("SELECT COUNT(*) AS n, SUM(l_partkey) AS s, AVG(l_quantity) AS a, MIN(l_returnflag) AS m FROM lineitem WHERE l_quantity < 0", "SELECT count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s, avg(l_quantity) AS a, min(l_returnflag) AS m FROM lineitem WHERE l_quantity < 0"),
    "order_multi": ("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey", None),
    "order_nulls": ("SELECT l_orderkey, number, maybe FROM lines ORDER BY maybe, l_orderkey, number", "SELECT l_orderkey, number, maybe FROM lines ORDER BY maybe NULLS FIRST, l_orderkey, number"),
    "order_by_expression": ("SELECT c_custkey, lengthUTF8(c_name) AS n FROM customer ORDER BY n DESC, c_custkey", "SELECT c_custkey, length(c_name) AS n FROM customer ORDER BY n DESC, c_custkey"),
    "limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10", None),
    "limit_comma": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10, 25", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10"),
    "distinct_one": ("SELECT DISTINCT c_mktsegment FROM customer", None),
    "distinct_tuple": ("SELECT DISTINCT l_returnflag, l_linestatus, maybe FROM lines WHERE l_quantity > 3 ORDER BY maybe DESC, l_returnflag, l_linestatus", "SELECT DISTINCT l_returnflag, l_linestatus, maybe FROM lines WHERE l_quantity > 3"),
    "union_all": ("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier", None),
    "union_distinct": ("SELECT c_nationkey AS nation FROM customer UNION DISTINCT SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS nation FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier"),
    "cross_join": ("SELECT * FROM nation CROSS JOIN region", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM nation CROSS JOIN region"),
    "inner_join": ("SELECT o_totalprice FROM orders INNER JOIN customer ON o_custkey = c_custkey", "SELECT o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey"),
    "left_join": ("SELECT o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "SELECT o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "row_number_ordered": ("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey DESC) AS rn FROM orders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS rn FROM orders"),
    "row_number_limit": ("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey ASC) AS rn FROM orders WHERE o_orderstatus = 'F' LIMIT 40", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 40"),
    "row_number_source": ("SELECT ROW_NUMBER() OVER () AS rn FROM orders", "SELECT row_number() OVER () AS rn FROM orders"),
    "length_bytes": ("SELECT doc_id, LENGTH(text) AS n FROM documents", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents"),
    "length_utf8": ("SELECT doc_id, lengthUTF8(text) AS n FROM documents", "SELECT doc_id, length(text) AS n FROM documents"),
    "empty_fn": ("SELECT doc_id, empty(source) AS e FROM documents", "SELECT doc_id, CAST(source = '' AS BIGINT) AS e FROM documents"),
    "lower_ascii": ("SELECT doc_id, LOWER(text) AS t FROM documents", "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents"),
    "upper_ascii": ("SELECT doc_id, UPPER(text) AS t FROM documents", "SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS t FROM documents"),
    "to_string_int": ("SELECT l_orderkey, toString(signed) AS t, toString(returned) AS b FROM lines", "SELECT l_orderkey, CAST(signed AS VARCHAR) AS t, CAST(returned AS VARCHAR) AS b FROM lines"),
    "abs_int": ("SELECT l_orderkey, ABS(signed) AS a FROM lines", None),
    "abs_float": ("SELECT l_orderkey, ABS(change) AS a FROM lines", None),
    "round_float": ("SELECT l_orderkey, ROUND(l_extendedprice) AS r FROM lineitem", None),
    "floor_float": ("SELECT l_orderkey, FLOOR(l_extendedprice) AS r FROM lineitem", None),
    "ceil_float": ("SELECT l_orderkey, CEIL(l_extendedprice) AS r FROM lineitem", None),
    "int_subtract": ("SELECT l_orderkey, l_partkey - 7 AS d, maybe - 2 AS e FROM lines", None),
    "cast_int_float": ("SELECT l_orderkey, CAST(l_partkey AS Float64) AS f FROM lineitem", "SELECT l_orderkey, CAST(l_partkey AS DOUBLE) AS f FROM lineitem"),
    "cast_float_int": ("SELECT l_orderkey, CAST(change AS Int64) AS i FROM lines", "SELECT l_orderkey, CAST(trunc(change) AS BIGINT) AS i FROM lines"),
    "cast_int_bool": ("SELECT l_orderkey, CAST(maybe AS Bool) AS b FROM lines", "SELECT l_orderkey, maybe <> 0 AS b FROM lines"),
    "cast_float_bool": ("SELECT l_orderkey, CAST(l_tax AS Bool) AS b FROM lineitem", "SELECT l_orderkey, l_tax <> 0 AS b FROM lineitem"),
    "cast_float_string": ("SELECT l_orderkey, CAST(l_extendedprice AS String) AS t FROM lineitem", "SELECT l_orderkey, regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', '') AS t FROM lineitem"),
    "cast_bool_int": ("SELECT l_orderkey, CAST(returned AS Int64) AS i, CAST(returned AS Float64) AS f FROM lines", "SELECT l_orderkey, CAST(returned AS BIGINT) AS i, CAST(returned AS DOUBLE) AS f FROM lines"),
    "cast_string_int": ("SELECT l_orderkey, CAST(key_text AS Int64) AS i FROM lines", "SELECT l_orderkey, l_orderkey AS i FROM lines"),
    "cast_string_float": ("SELECT l_orderkey, CAST(price_text AS Float64) AS f FROM lines", "SELECT l_orderkey, CAST(price_text AS DOUBLE) AS f FROM lines"),
    "cast_string_bool": ("SELECT l_orderkey, CAST(flag_text AS Bool) AS b FROM lines", "SELECT l_orderkey, returned AS b FROM lines"),
    "if_null": ("SELECT l_orderkey, ifNull(maybe, -1) AS v FROM lines", "SELECT l_orderkey, coalesce(maybe, -1) AS v FROM lines"),
    "is_null_fn": ("SELECT l_orderkey, isNull(maybe) AS v FROM lines", "SELECT l_orderkey, maybe IS NULL AS v FROM lines"),
    "is_not_null_fn": ("SELECT l_orderkey, isNotNull(maybe) AS v FROM lines", "SELECT l_orderkey, maybe IS NOT NULL AS v FROM lines"),
    "literal_select": ("SELECT 'it''s' AS v", None),
    "typed_null": ("SELECT CAST(NULL AS Int64) AS v", "SELECT CAST(NULL AS BIGINT) AS v"),
    "current_database": ("SELECT currentDatabase() AS d", "SELECT 'default' AS d"),
    "alter_add_column": ("ALTER TABLE part ADD COLUMN extra Int64; ALTER TABLE part ADD COLUMN note String; SELECT p_partkey, extra, note FROM part", "SELECT p_partkey, CAST(0 AS BIGINT) AS extra, '' AS note FROM part"),
    "alter_rename_drop": ("ALTER TABLE part RENAME COLUMN p_name TO title; ALTER TABLE part DROP COLUMN p_type; RENAME TABLE part TO pieces; SELECT p_partkey, title FROM pieces", "SELECT p_partkey, p_name AS title FROM part"),
    "alter_update": ("ALTER TABLE orders UPDATE o_orderstatus = 'X' WHERE o_orderpriority = '1-URGENT'; SELECT o_orderkey, o_orderstatus FROM orders", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"),
    "delete_where": ("DELETE FROM lines WHERE maybe >= 2 AND maybe < 6; SELECT l_orderkey, maybe FROM lines", "SELECT l_orderkey, maybe FROM lines WHERE NOT coalesce(maybe >= 2 AND maybe < 6, false)"),
    "truncate_table": ("TRUNCATE TABLE region; SELECT COUNT(*) AS n FROM region", "SELECT CAST(0 AS BIGINT) AS n"),
    "insert_defaults": ("CREATE TABLE t (a Int64, b String, c Nullable(Int64)); INSERT INTO t (a) VALUES (1), (2); INSERT INTO t VALUES (3, 'x', NULL), (4, 'it''s', 5); SELECT a, b, c FROM t", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), '', CAST(NULL AS BIGINT)), (2, '', NULL), (3, 'x', NULL), (4, 'it''s', 5)) v(a, b, c)"),
    "system_functions": ("SHOW FUNCTIONS", "SELECT unnest(string_split('ABS AVG CAST CEIL COUNT countIf currentDatabase empty FLOOR ifNull isNotNull isNull LENGTH lengthUTF8 LOWER MAX MIN ROUND ROW_NUMBER SUM toString UPPER version', ' ')) AS name"),
    "system_columns": ("CREATE TABLE t (a Int64, b Nullable(Int64)); SELECT database, table, name, type, position FROM system.columns", "SELECT 'default' AS database, 't' AS \"table\", * FROM (VALUES ('a', 'Int64', CAST(1 AS BIGINT)), ('b', 'Nullable(Int64)', 2)) v(name, type, position)"),
}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir, {"lines"})["lines"]


#: Operators that the session dialect has as functions of frames.
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "scan_kernel": (lambda s, d: kernels.scan(lines(s, d).select("l_orderkey", "maybe"), "maybe", ">", 4), "SELECT l_orderkey, maybe FROM lines WHERE maybe > 4"),
    "null_scan_kernel": (lambda s, d: kernels.scan_null(lines(s, d).select("l_orderkey", "maybe"), "maybe"), "SELECT l_orderkey, maybe FROM lines WHERE maybe IS NULL"),
    "top_k_nulls_first": (
        lambda s, d: kernels.top_k(lines(s, d).selectExpr("maybe", "l_orderkey * 10 + number as id"), "maybe", 60, True, True, "id"),
        "SELECT maybe, l_orderkey * 10 + number AS id FROM lines ORDER BY maybe DESC NULLS FIRST, id LIMIT 60",
    ),
    "top_k_nulls_last": (
        lambda s, d: kernels.top_k(lines(s, d).selectExpr("maybe", "l_orderkey * 10 + number as id"), "maybe", 60, False, False, "id"),
        "SELECT maybe, l_orderkey * 10 + number AS id FROM lines ORDER BY maybe ASC NULLS LAST, id LIMIT 60",
    ),
    "distinct_kernel": (lambda s, d: kernels.distinct(lines(s, d), "maybe"), "SELECT DISTINCT maybe FROM lines"),
    "grouped_count_kernel": (lambda s, d: kernels.grouped_count(lines(s, d), "maybe"), 'SELECT maybe AS "key", count(*) AS "count" FROM lines GROUP BY maybe'),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: partial(ask, script) for k, (script, _) in QUERIES.items()} | {k: f for k, (f, _) in (FRAMES | surfaces.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql(other or script) for k, (script, other) in QUERIES.items()} | {k: sql(x) for k, (_, x) in FRAMES.items()} | {k: x for k, (_, x) in surfaces.QUERIES.items()}
