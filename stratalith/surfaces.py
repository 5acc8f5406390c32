"""Queries over what surrounds the engine: files, formats, snapshots, the log, metadata, the command line and HTTP.

Each gives rows that SQL can give too. Tables that a session holds are small ones (region, nation), read whole; what takes
tables of any size reads orders or customer.
"""

from __future__ import annotations

import io
import threading
import urllib.request
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import __version__, cli
from .catalog import entry_of
from .engine import Engine
from .errors import EngineError
from .http_server import Principal, Service, server
from .limits import QueryLimits, TableLimits
from .operators import kernels
from .sources import formats, ingest, persist
from .sql import parse

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new place in the folder that all executors share; it goes with the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/surface-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def rows(spark: SparkSession, kind: str, found: list[tuple]) -> DataFrame:
    return spark.createDataFrame(found, kind)


def lines(spark: SparkSession, text: str) -> DataFrame:
    return rows(spark, "n bigint, line string", list(enumerate(text.split("\n")[:-1], 1)))


def session(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """A session with its default limits and small tables in it."""
    engine = Engine(spark)
    for name in names:
        fields = entry_of(name, table(spark, sf_dir, name)).fields
        engine.execute(f"CREATE TABLE {name} ({', '.join(f'{f.name} {f.type}' for f in fields)})")
        key = fields[0].name
        engine.append(name, [tuple(r) for r in entry_of(name, table(spark, sf_dir, name)).df.orderBy(key).collect()])
    return engine


def open_engine(spark: SparkSession) -> Engine:
    return Engine(spark, QueryLimits.none(), TableLimits(None, None, None), ordered=False)


def read_files(kind: str, columns: str, made: Callable[[DataFrame], DataFrame], query: str, base: str = "customer") -> Query:
    """Writes a table as lines of text, reads the files into a table of the engine, and queries that."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = folder(spark)
        made(table(spark, sf_dir, base)).write.text(path)
        engine = open_engine(spark)
        engine.execute(f"CREATE TABLE t ({columns})")
        ingest.append_files(engine, "t", path, kind)
        return engine.frame(query)

    return run


def quoted(*columns: str) -> F.Column:
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def csv_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, engine = folder(spark), open_engine(spark)
    engine.execute("CREATE TABLE t (k Int64, price Float64, name String)")
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.concat(F.lit('a "b", '), "o_orderpriority").alias("name")).write.csv(path, header=True, quote='"', escape='"')
    return ingest.from_csv_files(engine, "t", path)


def tsv_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = session(spark, sf_dir, "nation")
    text = formats.written(engine.query("SELECT n_nationkey, n_name, n_regionkey FROM nation"), "tsv")
    engine.execute("CREATE TABLE t (n_nationkey Int64, n_name String, n_regionkey Int64)")
    ingest.tsv_with_names(engine, "t", text.encode())
    return engine.frame("SELECT n_nationkey, n_name, n_regionkey FROM t")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, engine = folder(spark), open_engine(spark)
    df = table(spark, sf_dir, "orders").selectExpr("cast(o_custkey as bigint) as o_custkey", "o_orderkey", "o_totalprice")
    cuts = [(-(2**63), 9), (10, 39), (40, 149), (150, 2**63 - 1)]
    persist.write_ranges(df, "o_custkey", cuts, path)
    return persist.read_ranges(engine, "o_custkey", cuts, path, 20, 60)


def snapshot(again: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, engine = folder(spark), Engine.over(spark, {n: table(spark, sf_dir, n) for n in ("customer", "nation")})
        persist.save(engine, path)
        if again:  # over an older one
            engine.execute("ALTER TABLE nation UPDATE n_name = 'X' WHERE n_nationkey = 3")
            persist.save(engine, path, replace=True)
        fresh = open_engine(spark)
        persist.restore(fresh, path)
        return fresh.frame("SELECT n_nationkey, n_name FROM nation" if again else "SELECT c_custkey, c_name, c_mktsegment FROM customer")

    return run


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends, an UPDATE, a replace record, an append after it; replayed into a fresh session."""
    path, engine = folder(spark), session(spark, sf_dir, "nation")
    found = engine.query("SELECT n_nationkey, n_name FROM nation").rows()

    def started() -> tuple[Engine, persist.Log]:
        e = Engine(spark)
        e.execute("CREATE TABLE t (k Int64, name String)")
        return e, persist.Log(e, path, "t")

    first, kept = started()
    kept.append([(1, "gone")])
    kept.truncate()
    kept.append(found[:20])
    first.execute("ALTER TABLE t UPDATE name = 'changed' WHERE k = 2; DELETE FROM t WHERE k = 5")
    kept.replace()
    kept.append(found[20:])
    fresh, again = started()
    again.replay()
    return fresh.frame("SELECT k, name FROM t")


def log_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, engine = folder(spark), session(spark, sf_dir, "nation")
    found = engine.query("SELECT n_nationkey, n_regionkey FROM nation").rows()
    for e, replayed in ((Engine(spark), False), (Engine(spark), True)):
        e.execute("CREATE TABLE t (k Int64, r Int64)")
        kept = persist.Log(e, path, "t")
        for i in range(0, len(found), 10):
            if not replayed:
                kept.append(found[i : i + 10])
    kept.replay()
    return e.frame("SELECT k, r FROM t")


def formatted(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = session(spark, sf_dir, "nation")
        return lines(spark, formats.written(engine.query("SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey"), name))

    return run


def prometheus(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = Service(session(spark, sf_dir, "nation", "region")).metrics()
    return rows(spark, "line string", [(x,) for x in text.splitlines() if "table_rows{" in x or "value_bytes{" in x])


def shown(script: str) -> Query:
    """The last result of a script in a session that holds region."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return session(spark, sf_dir, "region").execute(script)[-1].df

    return run


def judged(cases: dict[str, str]) -> Query:
    """Of each statement whether a session takes it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = session(spark, sf_dir, "region")

        def taken(text: str) -> bool:
            try:
                for s in parse(text):
                    engine.run(s)
            except EngineError:
                return False
            return True

        return rows(spark, "statement string, taken boolean", [(k, taken(x)) for k, x in cases.items()])

    return run


def values(cases: dict[str, bool]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(v).lower()})" for k, v in cases.items()) + ") v(statement, taken)"


SHAPES = {
    "row number with DISTINCT": "SELECT DISTINCT ROW_NUMBER() OVER () FROM region",
    "row number with GROUP BY": "SELECT ROW_NUMBER() OVER (), COUNT(*) FROM region GROUP BY r_regionkey",
    "row number with an aggregate": "SELECT ROW_NUMBER() OVER (), COUNT(*) FROM region",
    "row number with ORDER BY": "SELECT r_name, ROW_NUMBER() OVER () FROM region ORDER BY r_name",
    "row number with OFFSET": "SELECT r_name, ROW_NUMBER() OVER () FROM region LIMIT 2 OFFSET 1",
    "row number with LIMIT": "SELECT r_name, ROW_NUMBER() OVER () FROM region LIMIT 2",
}
DEPTHS = {
    **{f"depth {n}": "SELECT r_name FROM region WHERE " + "(" * n + "r_regionkey = 1" + ")" * n for n in (1, 60, 70)},
    **{f"nodes {n}": "SELECT r_name FROM region WHERE " + " OR ".join(["r_regionkey = 1"] * n) for n in (2, 120, 300)},
}


def insert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that is taken, and one that is refused whole."""
    engine = session(spark, sf_dir, "region")
    engine.execute_insert_batch("INSERT INTO region VALUES (100, 'a'); INSERT INTO region (r_name) VALUES ('b')")
    for bad in ("INSERT INTO region VALUES (101, 'c'); INSERT INTO region VALUES ('x', 'y')", "INSERT INTO region VALUES (102, 'd'); TRUNCATE TABLE region"):
        try:
            engine.execute_insert_batch(bad)
        except EngineError:
            pass
    return engine.frame("SELECT r_regionkey, r_name FROM region")


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.StringIO()
    cli.run_script(session(spark, sf_dir, "nation"), b"DELETE FROM nation WHERE n_regionkey = 1; SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey", "csv", out)
    return lines(spark, out.getvalue())


def command_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.StringIO()
    cli.run_session(session(spark, sf_dir, "nation"), ["SELECT n_nationkey FROM nation ORDER BY n_nationkey\n", "\n", "SELECT COUNT(*) FROM nation\n"], out)
    return lines(spark, out.getvalue())


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine.over(spark, {"orders": table(spark, sf_dir, "orders")}).frame("SELECT o_orderstatus, COUNT(*) AS n, MIN(o_orderkey) AS low FROM orders GROUP BY o_orderstatus")


PEOPLE = (Principal("reader", "let me read", False), Principal("writer", "let me write"))


def asked(requests: list[tuple]) -> Query:
    """n, status and text of requests (method, target, body, headers), one after the other, to one service."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        service = Service(session(spark, sf_dir, "nation"), PEOPLE)
        found = []
        for n, (method, target, body, *more) in enumerate(requests, 1):
            status, text = service.answer(method, target, {"authorization": "Bearer let me write"} | (more[0] if more else {}), body)
            found.append((n, status, text if status == 200 else ""))
        return rows(spark, "n bigint, status bigint, text string", found)

    return run


def listener(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query through a socket."""
    with server(session(spark, sf_dir, "nation"), 0) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_address[1]}/", data=b"SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey FORMAT CSV")
        with urllib.request.urlopen(request, timeout=120) as r:
            text = r.read().decode()
        http.shutdown()
    return lines(spark, text)


CHOSEN = "SELECT n_nationkey FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey"
JOINED = "SELECT string_agg(n_nationkey || chr(10), '' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = 2"
NUMBERED = "SELECT row_number() OVER (ORDER BY n_nationkey) + 1 AS n, {} AS line FROM nation"
WIDTHS = "SELECT greatest(11, max(length(n_nationkey::VARCHAR))) AS a, greatest(6, max(length(n_name))) AS b, greatest(11, max(length(n_regionkey::VARCHAR))) AS c FROM nation"
ARRAYS = "'[' || n_nationkey || ',\"' || n_name || '\",' || n_regionkey || ']'"

#: name: the query, and the SQL that gives the same rows.
QUERIES: dict[str, tuple[Query, str]] = {
    "index_scan": (lambda s, d: Engine.over(s, {"orders": table(s, d, "orders").sort("o_orderkey")}).frame("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900"),
    "range_partition_scan": (ranges, "SELECT CAST(o_custkey AS BIGINT) AS o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 20 AND 60"),
    "read_csv": (read_files("csv", "k Int64, name String, segment String", lambda t: t.select(quoted("c_custkey", "c_name", "c_mktsegment")), "SELECT k, name, segment FROM t"), "SELECT CAST(c_custkey AS BIGINT) AS k, c_name AS name, c_mktsegment AS segment FROM customer"),
    "read_csv_with_names": (csv_with_names, "SELECT o_orderkey AS k, o_totalprice AS price, 'a \"b\", ' || o_orderpriority AS name FROM orders"),
    "read_tsv": (read_files("tsv", "k Int64, name String, x Nullable(Int64)", lambda t: t.select(F.concat_ws("\t", F.col("c_custkey"), F.concat(F.lit("tab\\t"), "c_name"), F.when(F.col("c_nationkey") < 10, F.lit("\\N")).otherwise(F.col("c_nationkey").cast("string")))), "SELECT k, name, x FROM t"), "SELECT CAST(c_custkey AS BIGINT) AS k, 'tab' || chr(9) || c_name AS name, CASE WHEN c_nationkey >= 10 THEN CAST(c_nationkey AS BIGINT) END AS x FROM customer"),
    "read_tsv_with_names": (tsv_with_names, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    "read_json_arrays": (read_files("jsoncompacteachrow", "v Nullable(Int64)", lambda t: t.select(F.concat(F.lit("[ "), F.when(F.col("o_custkey") % 7 == 0, "null").otherwise(F.col("o_custkey").cast("string")), F.lit("]"))), "SELECT v FROM t", "orders"), "SELECT CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS BIGINT) END AS v FROM orders"),
    "read_one_column": (read_files("csv", "v Nullable(Int64)", lambda t: t.select(F.when(F.col("o_custkey") % 5 == 0, "NULL").otherwise(F.col("o_custkey").cast("string"))), "SELECT v FROM t", "orders"), "SELECT CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey AS BIGINT) END AS v FROM orders"),
    "snapshot_restore": (snapshot(False), "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_mktsegment FROM customer"),
    "snapshot_save_again": (snapshot(True), "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END AS n_name FROM nation"),
    "log_recovery": (log_appends, "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r FROM nation"),
    "log_records": (log, "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey = 2 THEN 'changed' ELSE n_name END AS name FROM nation WHERE n_nationkey <> 5"),
    "format_table": (formatted("table"), f"""WITH w AS ({WIDTHS}), b AS (SELECT '+' || repeat('-', a + 2) || '+' || repeat('-', b + 2) || '+' || repeat('-', c + 2) || '+' AS line FROM w),
        r AS (SELECT row_number() OVER (ORDER BY n_nationkey) + 3 AS n, '| ' || rpad(n_nationkey::VARCHAR, a::INT, ' ') || ' | ' || rpad(n_name, b::INT, ' ') || ' | ' || rpad(n_regionkey::VARCHAR, c::INT, ' ') || ' |' AS line FROM nation, w)
        SELECT 1::BIGINT AS n, line FROM b UNION ALL SELECT 3, line FROM b UNION ALL SELECT count(*) + 4, (SELECT line FROM b) FROM r
        UNION ALL SELECT 2, '| ' || rpad('n_nationkey', a::INT, ' ') || ' | ' || rpad('n_name', b::INT, ' ') || ' | ' || rpad('n_regionkey', c::INT, ' ') || ' |' FROM w UNION ALL SELECT * FROM r"""),
    "format_csv": (formatted("csv"), "SELECT 1::BIGINT AS n, 'n_nationkey,n_name,n_regionkey' AS line UNION ALL " + NUMBERED.format("n_nationkey || ',' || n_name || ',' || n_regionkey")),
    "format_tsv": (formatted("tsv"), "SELECT 1::BIGINT AS n, 'n_nationkey' || chr(9) || 'n_name' || chr(9) || 'n_regionkey' AS line UNION ALL " + NUMBERED.format("n_nationkey || chr(9) || n_name || chr(9) || n_regionkey")),
    "format_json": (formatted("json"), f"""SELECT 1::BIGINT AS n, '{{"columns":[{{"name":"n_nationkey","type":"Int64"}},{{"name":"n_name","type":"String"}},{{"name":"n_regionkey","type":"Int64"}}],"rows":[' || string_agg({ARRAYS}, ',' ORDER BY n_nationkey) || ']}}' AS line FROM nation"""),
    "format_json_each_row": (formatted("JSONEachRow"), NUMBERED.replace("+ 1 AS", "AS").format("""'{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}'""")),
    "format_json_compact_each_row": (formatted("JSONCompactEachRow"), NUMBERED.replace("+ 1 AS", "AS").format(ARRAYS)),
    "prometheus_metrics": (prometheus, """SELECT 'stratalith_table_rows{table="nation"} ' || count(*) AS line FROM nation UNION ALL SELECT 'stratalith_table_rows{table="region"} ' || count(*) FROM region
        UNION ALL SELECT 'stratalith_table_value_bytes{table="nation"} ' || CAST(sum(16 + strlen(n_name)) AS BIGINT) FROM nation UNION ALL SELECT 'stratalith_table_value_bytes{table="region"} ' || CAST(sum(8 + strlen(r_name)) AS BIGINT) FROM region"""),
    "version_function": (shown("SELECT version() AS v"), f"SELECT '{__version__}' AS v"),
    "predicate_limits": (judged(DEPTHS), values({k: k not in ("depth 70", "nodes 300") for k in DEPTHS})),
    "contextual_keywords": (shown("CREATE TABLE t (not Int64, like String, if Int64); INSERT INTO t VALUES (1, 'a', 2), (3, 'b', 4); SELECT not, like, if FROM t WHERE not = 3 OR like = 'a' AND NOT if = 7"), "SELECT * FROM (VALUES (1::BIGINT, 'a', 2::BIGINT), (3, 'b', 4)) v(\"not\", \"like\", \"if\")"),
    "row_number_shapes": (judged(SHAPES), values({k: k == "row number with LIMIT" for k in SHAPES})),
    "parallel_reducers": (lambda s, d: Engine.over(s, {"lineitem": table(s, d, "lineitem").repartition(64)}).frame("SELECT COUNT(*) AS n, SUM(l_partkey) AS s, MIN(l_orderkey) AS a, MAX(l_suppkey) AS b FROM lineitem"), "SELECT count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s, min(l_orderkey) AS a, max(l_suppkey) AS b FROM lineitem"),
    "drop_table": (shown("CREATE TABLE a (x Int64); CREATE TABLE b (x Int64); DROP TABLE a; DROP TABLE IF EXISTS a; SHOW TABLES"), "SELECT * FROM (VALUES ('b'), ('region')) v(name)"),
    "insert_batch": (insert_batch, "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (100::BIGINT, 'a'), (0, 'b')) v"),
    "one_column_create": (shown("CREATE TABLE IF NOT EXISTS t (c Int64 NULL) ENGINE = Memory; CREATE TABLE u (c Int64 NOT NULL); SELECT database, table, name, type, position FROM system.columns"), "SELECT 'default' AS database, * FROM (VALUES ('region', 'r_regionkey', 'Int64', 1::BIGINT), ('region', 'r_name', 'String', 2), ('t', 'c', 'Nullable(Int64)', 1), ('u', 'c', 'Int64', 1)) v(\"table\", name, type, position)"),
    "one_column_insert": (shown("CREATE TABLE t (c Int64 NULL); INSERT INTO t VALUES (7); INSERT INTO t VALUES (NULL); INSERT INTO t VALUES (-2); SELECT c FROM t"), "SELECT * FROM (VALUES (7::BIGINT), (NULL), (-2)) v(c)"),
    "order_nulls_placed": (lambda s, d: Engine.over(s, {"t": table(s, d, "lineitem").selectExpr("CAST(nullif(l_linenumber, 3) AS BIGINT) AS c")}).frame("SELECT c FROM t WHERE c IS NULL OR c >= 2 ORDER BY c DESC NULLS FIRST LIMIT 5000"), "SELECT CAST(nullif(l_linenumber, 3) AS BIGINT) AS c FROM lineitem WHERE l_linenumber >= 2 ORDER BY c DESC NULLS FIRST LIMIT 5000"),
    "show_databases": (shown("SHOW DATABASES"), "SELECT 'default' AS name"),
    "show_settings": (shown("SHOW SETTINGS"), "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in (
        *((f"query_result_limits.{k}", v) for k, v in vars(QueryLimits()).items()), *((f"table_limits.{k}", v) for k, v in vars(TableLimits()).items()), ("global_aggregate_worker_cap", 16))) + ") v(name, value)"),
    "show_tables": (shown("CREATE TABLE T2 (x Int64); SHOW TABLES"), "SELECT * FROM (VALUES ('region'), ('T2')) v(name)"),
    "show_create": (shown("CREATE TABLE t (a Int64, b Bool, c Nullable(Int64)); SHOW CREATE TABLE t"), "SELECT 'CREATE TABLE t (a Int64, b Bool, c Nullable(Int64)) ENGINE = Memory' AS statement"),
    "describe_table": (shown("DESCRIBE TABLE region"), "SELECT * FROM (VALUES ('r_regionkey', 'Int64'), ('r_name', 'String')) v(name, type)"),
    "exists_table": (shown("EXISTS TABLE Region"), "SELECT true AS result"),
    "system_tables": (shown("SELECT database, name, engine, total_rows FROM system.tables"), "SELECT 'default' AS database, 'region' AS name, 'Memory' AS engine, count(*) AS total_rows FROM region"),
    "system_metrics": (shown("SELECT metric, value FROM system.metrics"), """SELECT 'stratalith_tables' AS metric, 1::BIGINT AS value UNION ALL SELECT 'stratalith_columns', 2
        UNION ALL SELECT 'stratalith_retained_rows', count(*) FROM region UNION ALL SELECT 'stratalith_retained_value_bytes', CAST(sum(8 + strlen(r_name)) AS BIGINT) FROM region"""),
    "command_line": (command_line, "SELECT 1::BIGINT AS n, 'n_nationkey,n_name' AS line UNION ALL " + NUMBERED.format("n_nationkey || ',' || n_name") + " WHERE n_regionkey <> 1"),
    "command_session": (command_session, "SELECT 1::BIGINT AS n, '[' || string_agg(n_nationkey::VARCHAR, ', ' ORDER BY n_nationkey) || ']' AS line FROM nation UNION ALL SELECT 2, '[' || count(*) || ']' FROM nation"),
    "library_api": (library, "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS low FROM orders GROUP BY o_orderstatus"),
    "http_query": (asked([("POST", "/?default_format=CSV", CHOSEN.encode()), ("GET", "/ping", b""), ("GET", "/nothing", b"")]), f"SELECT 1::BIGINT AS n, 200::BIGINT AS status, ({JOINED}) AS text UNION ALL SELECT 2, 200, 'Ok.' || chr(10) UNION ALL SELECT 3, 404, ''"),
    "http_formats": (asked([("POST", "/", f"{CHOSEN} FORMAT TabSeparated".encode()), ("POST", "/", CHOSEN.encode(), {"x-clickhouse-format": "CSVWithNames"}), ("POST", "/?default_format=CSV", f"{CHOSEN} FORMAT CSV".encode())]), f"SELECT 1::BIGINT AS n, 200::BIGINT AS status, ({JOINED}) AS text UNION ALL SELECT 2, 200, 'n_nationkey' || chr(10) || ({JOINED}) UNION ALL SELECT 3, 400, ''"),
    "http_insert": (asked([("POST", "/insert/nation", b"200,x,1\n201,y,2\n"), ("POST", "/insert", b"INSERT INTO nation VALUES (202, 'z', 2)"), ("POST", "/?default_format=CSV", CHOSEN.encode())]), f"SELECT 1::BIGINT AS n, 200::BIGINT AS status, '2' || chr(10) AS text UNION ALL SELECT 2, 200, '1' || chr(10) UNION ALL SELECT 3, 200, ({JOINED}) || '201' || chr(10) || '202' || chr(10)"),
    "http_limits": (asked([
        ("POST", "/?default_format=CSV&max_result_rows=1", CHOSEN.encode()), ("POST", "/?default_format=CSV&max_rows_to_read=3", CHOSEN.encode()), ("POST", "/?max_rows_to_group_by=2", b"SELECT n_regionkey, COUNT(*) AS c FROM nation GROUP BY n_regionkey LIMIT 1"),
        ("POST", "/?max_rows_to_group_by=2", b"SELECT n_regionkey, COUNT(*) AS c FROM nation GROUP BY n_regionkey HAVING c > 99"), ("POST", "/?max_group_key_cells=2", b"SELECT n_regionkey FROM nation GROUP BY n_regionkey"), ("POST", "/?max_group_key_bytes=9", b"SELECT n_name FROM nation GROUP BY n_name"),
        ("POST", "/?max_ordering_state_bytes=20", CHOSEN.encode()), ("POST", "/?max_aggregate_state_cells=4", b"SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey"), ("POST", "/?max_aggregate_state_bytes=9", b"SELECT n_regionkey, MIN(n_name) FROM nation GROUP BY n_regionkey"),
        ("POST", "/?default_format=CSV&max_result_rows=0&max_ordering_state_bytes=0", CHOSEN.encode())]),
        f"SELECT n::BIGINT AS n, 400::BIGINT AS status, '' AS text FROM range(1, 10) t(n) UNION ALL SELECT 10, 200, ({JOINED})"),
    "http_authentication": (asked([(m, t, b, {"authorization": a}) for m, t, b, a in (("POST", "/?default_format=CSV", CHOSEN.encode(), "Bearer let me read"), ("POST", "/insert/nation", b"1,a,1\n", "Bearer let me read"), ("POST", "/", b"SELECT n_name FROM nation", "Bearer other"), ("GET", "/ready", b"", ""))]), f"SELECT 1::BIGINT AS n, 200::BIGINT AS status, ({JOINED}) AS text UNION ALL SELECT 2, 403, '' UNION ALL SELECT 3, 401, '' UNION ALL SELECT 4, 200, 'Ok.' || chr(10)"),
    "http_listener": (listener, NUMBERED.replace("+ 1 AS", "AS").format("n_nationkey || ',' || n_name")),
    "equi_join_kernel": (lambda s, d: kernels.equi_join(table(s, d, "nation"), table(s, d, "region"), "n_regionkey", "r_regionkey", "inner").select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "cast_nullable_float": (lambda s, d: Engine.over(s, {"t": table(s, d, "lineitem").selectExpr("CAST(nullif(l_linenumber, 3) AS BIGINT) AS c")}).frame("SELECT CAST(c AS Float64) AS f, CAST(c AS String) AS t FROM t"), "SELECT CAST(nullif(l_linenumber, 3) AS DOUBLE) AS f, CAST(nullif(l_linenumber, 3) AS VARCHAR) AS t FROM lineitem"),
}
