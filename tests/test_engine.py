"""Values, errors and limits of statements, on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F
from stratalith.operators.kernels import numbered
from stratalith.engine import Command, Engine, SharedEngine
from stratalith.errors import (
    ColumnNotFound,
    DatabaseBusy,
    DuplicateColumn,
    InsertOnlyStatementRequired,
    InvalidCast,
    InvalidQuery,
    NumericOverflow,
    ReservedIdentifier,
    ResourceLimitExceeded,
    RowLength,
    SqlError,
    StatementLimitExceeded,
    TableAlreadyExists,
    TableNotFound,
    TypeMismatch,
    UnionColumnCountMismatch,
)
from stratalith.limits import QueryLimits, SqlLimits, TableLimits
from stratalith.sql import parse

MAX, MIN = 2**63 - 1, -(2**63)


@pytest.fixture(scope="module")
def db(spark):
    e = Engine(spark)
    e.execute(
        f"""
    CREATE TABLE samples (i Int64, f Float64, b Bool, s String);
    INSERT INTO samples VALUES (2, 2.5, true, 'beta'), (1, -1.0, false, 'alpha'), (2, 2.5, true, 'beta'), (3, 4.0, false, 'gamma'), (1, -1.0, true, 'alpha');
    CREATE TABLE Readings (measurement Nullable(Int64));
    INSERT INTO readings VALUES (NULL), (3), (NULL), (1), (2), (NULL), (3);
    CREATE TABLE events (id Int64, rank_key Int64, label String);
    INSERT INTO events VALUES (1, 2, 'a'), (2, 1, 'b'), (3, 2, 'c'), (4, 1, 'd'), (5, 3, 'e'), (6, 0, 'f');
    CREATE TABLE sums (cohort String, v Nullable(Int64));
    INSERT INTO sums VALUES ('a', {MAX}), ('a', 1), ('a', NULL), ('a', -1), ('b', {MAX}), ('b', NULL), ('b', 1), ('c', {MAX}), ('c', {MIN}), ('d', NULL);
    CREATE TABLE floats (r Float64, id Int64);
    INSERT INTO floats VALUES (-9223372036854775808.0, 1), (9223372036854774784.0, 2), (-12.9, 3), (7.9, 4), (-0.9, 5), (0.9, 6), (9223372036854775808.0, 7), (1e23, 8), (-0.0, 9);
    CREATE TABLE texts (id Int64, s String);
    INSERT INTO texts VALUES (1, ''), (2, 'MiXeD_ÀÉ'), (3, '東京'), (4, 'a_b%c'), (5, 'straße'), (6, '+17'), (7, ' 7 '), (8, '99999999999999999999'), (9, '-6.25e1'), (10, 'tRuE'), (11, '7\n');
    CREATE TABLE ints (i Int64, n Nullable(Int64));
    INSERT INTO ints VALUES (9007199254740993, NULL), ({MIN}, 0), ({MAX}, 5), (2, -5)
    """
    )
    return e


def rows(db, sql):
    return db.query(sql).rows()


def test_source_order_and_stable_sorts(db):
    assert rows(db, "SELECT i FROM samples LIMIT 3 OFFSET 1") == [(1,), (2,), (3,)]
    assert rows(db, "SELECT i, b FROM samples ORDER BY i DESC") == [(3, False), (2, True), (2, True), (1, False), (1, True)]
    assert rows(db, "SELECT s, COUNT(*) FROM samples GROUP BY s") == [("beta", 2), ("alpha", 2), ("gamma", 1)]
    assert rows(db, "SELECT DISTINCT s, i FROM samples") == [("beta", 2), ("alpha", 1), ("gamma", 3)]
    assert rows(db, "SELECT measurement FROM readings ORDER BY measurement") == [(None,)] * 3 + [(1,), (2,), (3,), (3,)]
    assert rows(db, "SELECT measurement, COUNT(*) AS n FROM readings GROUP BY measurement ORDER BY n DESC, measurement DESC") == [(None, 3), (3, 2), (2, 1), (1, 1)]


def test_nulls_in_predicates(db):
    assert rows(db, "SELECT COUNT(*) FROM readings WHERE NOT (measurement = 2)") == [(3,)]
    assert rows(db, "SELECT COUNT(*) FROM readings WHERE NOT (measurement = 2) OR measurement IS NULL") == [(6,)]
    with pytest.raises(InvalidQuery):
        db.query("SELECT i FROM samples WHERE i = NULL")


def test_exact_sums_and_means(db):
    got = rows(db, "SELECT cohort, AVG(v) AS a FROM sums GROUP BY cohort ORDER BY cohort")
    assert got[2:] == [("c", -0.5), ("d", None)] and got[1][1] == pytest.approx(2.0**62)
    assert rows(db, "SELECT SUM(v) FROM sums WHERE cohort = 'a'") == [(MAX,)]
    assert rows(db, "SELECT SUM(v) FROM sums WHERE cohort = 'd'") == [(None,)]
    with pytest.raises(NumericOverflow, match=r"SUM\(Int64\)"):
        rows(db, "SELECT SUM(v) FROM sums WHERE cohort = 'b'")


def test_exact_comparisons_of_integers_and_floats(db):
    assert rows(db, "SELECT i FROM ints WHERE i = 9007199254740992.0") == []
    assert rows(db, "SELECT i FROM ints WHERE i > 9007199254740992.0 AND i < 9007199254740994.0") == [(9007199254740993,)]
    assert rows(db, "SELECT i FROM ints WHERE i < 9223372036854775808.0 ORDER BY i") == [(MIN,), (2,), (9007199254740993,), (MAX,)]
    assert rows(db, "SELECT id FROM floats WHERE r = 9223372036854775807") == []
    assert rows(db, "SELECT id FROM floats WHERE r > 9223372036854775807 ORDER BY id") == [(7,), (8,)]
    assert rows(db, "SELECT id FROM floats WHERE r IN (0, 7.9)") == [(4,), (9,)]
    with pytest.raises(TypeMismatch, match="WHERE comparison"):
        db.query("SELECT i FROM samples WHERE i = '1'")


def test_casts(db):
    assert rows(db, "SELECT CAST(r AS Int64) AS v, id FROM floats WHERE id < 7 ORDER BY id") == [(MIN, 1), (9223372036854774784, 2), (-12, 3), (7, 4), (0, 5), (0, 6)]
    with pytest.raises(NumericOverflow, match=r"CAST\(Float64 AS Int64\)"):
        rows(db, "SELECT CAST(r AS Int64) AS v FROM floats")
    assert rows(db, "SELECT CAST(r AS String) AS v, id FROM floats WHERE id >= 7 ORDER BY id") == [("9223372036854776000", 7), ("1" + "0" * 23, 8), ("-0", 9)]
    assert rows(db, "SELECT CAST(s AS Int64) AS v FROM texts WHERE id = 6") == [(17,)]
    assert rows(db, "SELECT CAST(s AS Float64) AS v FROM texts WHERE id = 9") == [(-62.5,)]
    assert rows(db, "SELECT CAST(s AS Bool) AS v FROM texts WHERE id = 10") == [(True,)]
    for i in (1, 7, 11):
        with pytest.raises(InvalidCast):
            rows(db, f"SELECT CAST(s AS Int64) AS v FROM texts WHERE id = {i}")
    with pytest.raises(NumericOverflow):
        rows(db, "SELECT CAST(s AS Int64) AS v FROM texts WHERE id = 8")
    with pytest.raises(InvalidQuery):
        db.query("SELECT CAST(s AS String) FROM texts")


def test_values_outside_the_page_never_raise(db):
    assert rows(db, "SELECT ABS(i) AS a FROM ints ORDER BY a LIMIT 3") == [(2,), (9007199254740993,), (MAX,)]
    with pytest.raises(NumericOverflow, match=r"ABS\(Int64\)"):
        rows(db, "SELECT ABS(i) AS a FROM ints")
    assert rows(db, "SELECT i - 1 FROM ints ORDER BY i - 1 DESC LIMIT 3") == [(MAX - 1,), (9007199254740992,), (1,)]
    with pytest.raises(NumericOverflow, match="Int64 subtraction"):
        rows(db, "SELECT i - 1 FROM ints")
    assert rows(db, "SELECT CAST(r AS Int64) AS v, id FROM floats ORDER BY v LIMIT 2") == [(MIN, 1), (-12, 3)]
    assert rows(db, "SELECT CAST(s AS Int64) AS v FROM texts WHERE id = 8 OR id = 6 ORDER BY v LIMIT 1") == [(17,)]


def test_strings(db):
    assert rows(db, "SELECT LENGTH(s), lengthUTF8(s), empty(s), LOWER(s), UPPER(s) FROM texts WHERE id <= 5") == [
        (0, 0, 1, "", ""), (10, 8, 0, "mixed_ÀÉ", "MIXED_ÀÉ"), (6, 2, 0, "東京", "東京"), (5, 5, 0, "a_b%c", "A_B%C"), (7, 6, 0, "straße", "STRAßE")]
    assert rows(db, "SELECT id FROM texts WHERE s LIKE 'a_b%'") == [(4,)]
    assert rows(db, "SELECT id FROM texts WHERE s LIKE '%_%'") == [(2,), (4,)]
    assert rows(db, "SELECT COUNT(*) FROM texts WHERE s LIKE '%'") == [(11,)]
    for bad in ("'a%b'", "'abc'", "'%a%b%'"):
        with pytest.raises(SqlError):
            db.query(f"SELECT id FROM texts WHERE s LIKE {bad}")


def test_rounding(db):
    db.execute("CREATE TABLE halves (r Float64); INSERT INTO halves VALUES (2.5), (-2.5), (0.49999999999999994), (1e300), (-0.5)")
    assert rows(db, "SELECT ROUND(r), FLOOR(r), CEIL(r) FROM halves") == [(3.0, 2.0, 3.0), (-3.0, -3.0, -2.0), (0.0, 0.0, 1.0), (1e300,) * 3, (-1.0, -1.0, 0.0)]


def test_nullable_scalars_and_groups(db):
    assert rows(db, "SELECT ifNull(n, 7), isNull(n), isNotNull(n), toString(n) FROM ints") == [(7, True, False, None), (0, False, True, "0"), (5, False, True, "5"), (-5, False, True, "-5")]
    assert rows(db, "SELECT ifNull(n, 0) AS k, COUNT(*) FROM ints GROUP BY n") == [(0, 1), (0, 1), (5, 1), (-5, 1)]
    with pytest.raises(InvalidQuery, match="ungrouped"):
        db.query("SELECT LOWER(s), COUNT(*) FROM texts GROUP BY s")
    with pytest.raises(InvalidQuery, match="must appear in GROUP BY"):
        db.query("SELECT i, COUNT(*) FROM samples GROUP BY s")
    with pytest.raises(TypeMismatch):
        db.query("SELECT ifNull(i, 1) FROM ints")


def test_row_numbers(db):
    assert rows(db, "SELECT label, ROW_NUMBER() OVER (ORDER BY rank_key ASC) AS n FROM events") == [("f", 1), ("b", 2), ("d", 3), ("a", 4), ("c", 5), ("e", 6)]
    assert rows(db, "SELECT label, ROW_NUMBER() OVER (ORDER BY rank_key DESC) AS n FROM events LIMIT 2") == [("e", 1), ("a", 2)]
    assert rows(db, "SELECT ROW_NUMBER() OVER (), label FROM events WHERE rank_key = 2") == [(1, "a"), (2, "c")]
    for bad in ("SELECT DISTINCT ROW_NUMBER() OVER () FROM events", "SELECT ROW_NUMBER() OVER () FROM events ORDER BY id", "SELECT ROW_NUMBER() OVER (), COUNT(*) FROM events", "SELECT ROW_NUMBER() OVER (ORDER BY id) FROM events"):
        with pytest.raises((InvalidQuery, SqlError)):
            db.query(bad)


def test_set_operations_and_joins(db):
    assert rows(db, "SELECT i FROM samples WHERE i > 1 UNION DISTINCT SELECT id FROM events WHERE id < 4") == [(2,), (3,), (1,)]
    assert rows(db, "SELECT i AS x FROM samples LIMIT 1 UNION ALL SELECT id FROM events ORDER BY id DESC LIMIT 2") == [(2,), (6,), (5,)]
    with pytest.raises(UnionColumnCountMismatch):
        db.query("SELECT i FROM samples UNION ALL SELECT id, label FROM events")
    with pytest.raises(TypeMismatch):
        db.query("SELECT i FROM samples UNION ALL SELECT label FROM events")
    with pytest.raises(SqlError):
        db.query("SELECT i FROM samples UNION SELECT id FROM events")
    cross = db.query("SELECT * FROM readings CROSS JOIN events LIMIT 8")
    assert cross.columns == ["measurement", "id", "rank_key", "label"] and [r[:2] for r in cross.rows()] == [(None, i) for i in range(1, 7)] + [(3, 1), (3, 2)]
    db.execute("CREATE TABLE l (a Nullable(Int64)); INSERT INTO l VALUES (4), (NULL), (8); CREATE TABLE r (c Nullable(Int64)); INSERT INTO r VALUES (4), (4), (NULL)")
    assert rows(db, "SELECT a FROM l INNER JOIN r ON a = c") == [(4,), (4,)]
    assert rows(db, "SELECT c FROM l LEFT JOIN r ON a = c") == [(4,), (4,), (None,), (None,)]


def test_having(db):
    assert rows(db, "SELECT s, COUNT(*) AS n FROM samples GROUP BY s HAVING n > 1.5 ORDER BY s") == [("alpha", 2), ("beta", 2)]
    assert rows(db, "SELECT SUM(v) AS t FROM sums WHERE cohort = 'd' HAVING t IS NULL") == [(None,)]
    assert rows(db, "SELECT SUM(v) AS t FROM sums WHERE cohort = 'd' HAVING t > 0") == []
    with pytest.raises(InvalidQuery):
        db.query("SELECT s FROM samples GROUP BY s HAVING s > 1")


def test_names_and_literals(db):
    assert db.query("SELECT COUNT(), countif(B), sum(F) FROM SAMPLES").columns == ["COUNT()", "countIf(B)", "SUM(F)"]
    assert db.query("SELECT 'it''s'").columns == ["'it''s'"] and rows(db, "SELECT 2.5 AS v") == [(2.5,)]
    assert rows(db, "SELECT version()")[0][0].count(".") == 2 and rows(db, "SELECT currentDatabase()") == [("default",)]
    assert rows(db, "SELECT CAST(NULL AS Bool)") == [(None,)]
    assert rows(db, "SELECT -9223372036854775808") == [(MIN,)]
    db.execute("CREATE TABLE odd (not Int64, like Int64, if Int64); INSERT INTO odd VALUES (1, 2, 3)")
    assert rows(db, "SELECT not, like, if FROM odd WHERE NOT not = 2 AND like IN (2) AND if BETWEEN 1 AND 3") == [(1, 2, 3)]


def test_ddl_and_dml(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE T (a Int64, b String) ENGINE = Memory; INSERT INTO t (A) VALUES (1), (2)")
    before = e.query("SELECT a FROM t").df
    assert rows(e, "SELECT a, b FROM t") == [(1, ""), (2, "")]
    e.execute("ALTER TABLE t ADD COLUMN c Nullable(Int64); ALTER TABLE t ADD COLUMN IF NOT EXISTS C Int64; ALTER TABLE t ADD COLUMN d Bool")
    assert rows(e, "SHOW CREATE TABLE t") == [("CREATE TABLE T (a Int64, b String, c Nullable(Int64)) ENGINE = Memory;\nALTER TABLE T ADD COLUMN d Bool",)]
    assert [c.rows for c in e.execute("INSERT INTO t VALUES (3, 'x', NULL, true), (4, 'y', 9, false); ALTER TABLE t UPDATE c = 5 WHERE a = 1; ALTER TABLE t UPDATE c = NULL WHERE a = 4")] == [2, 1, 1]
    assert rows(e, "SELECT a, c, d FROM t") == [(1, 5, False), (2, None, False), (3, None, True), (4, None, False)]
    assert e.execute("DELETE FROM t WHERE c IS NULL")[0].rows == 3 and rows(e, "SELECT a FROM t") == [(1,)]
    assert [r[0] for r in before.collect()] == [1, 2]  # a frame keeps what it showed
    e.execute("ALTER TABLE t RENAME COLUMN a TO z; ALTER TABLE t DROP COLUMN b; RENAME TABLE t TO u")
    assert rows(e, "DESCRIBE TABLE U") == [("z", "Int64"), ("c", "Nullable(Int64)"), ("d", "Bool")]
    assert rows(e, "EXISTS TABLE u") == [(True,)] and rows(e, "EXISTS TABLE t") == [(False,)]
    assert rows(e, "SELECT database, name, engine, total_rows FROM system.tables") == [("default", "u", "Memory", 1)]
    assert len(rows(e, "SHOW SETTINGS")) == 14 and len(rows(e, "SHOW FUNCTIONS")) == 23 and rows(e, "SHOW TABLES FROM default") == [("u",)] and rows(e, "SHOW DATABASES") == [("default",)]
    assert dict(rows(e, "SELECT metric, value FROM system.metrics"))["stratalith_retained_value_bytes"] == 8 + 9 + 1
    assert e.execute("TRUNCATE TABLE u")[0].rows == 1 and rows(e, "SELECT COUNT(*) FROM u") == [(0,)]
    e.execute("DROP TABLE u; DROP TABLE IF EXISTS u; CREATE TABLE IF NOT EXISTS w (a Int64); CREATE TABLE IF NOT EXISTS w (b String)")
    for bad, error in {
        "DROP TABLE u": TableNotFound, "CREATE TABLE w (a Int64)": TableAlreadyExists, "CREATE TABLE v (a Int64, A Int64)": DuplicateColumn,
        "INSERT INTO w VALUES (1, 2)": RowLength, "INSERT INTO w VALUES (1.0)": TypeMismatch, "INSERT INTO w VALUES (NULL)": TypeMismatch, "SELECT x FROM w": ColumnNotFound,
        "ALTER TABLE w DROP COLUMN a": InvalidQuery, "CREATE TABLE v (true Int64)": ReservedIdentifier, "CREATE TABLE v (a Nullable(String))": SqlError,
        "CREATE TABLE v (a Nullable(Int64), b Int64)": SqlError, "CREATE TABLE v (a Nullable(Int64), b Nullable(Int64), c Nullable(Int64))": SqlError,
    }.items():
        with pytest.raises(error):
            e.execute(bad)


def test_many_changes_keep_plans_short(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("stratalith.engine.MAX_DEPTH", 3)
    e = Engine(spark)
    e.execute("CREATE TABLE t (a Int64)")
    for i in range(8):
        e.execute(f"INSERT INTO t VALUES ({i})")
    assert rows(e, "SELECT a FROM t") == [(i,) for i in range(8)] and e.catalog.get("t").depth < 3


def test_batches_are_atomic(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE t (a Int64)")
    with pytest.raises(TypeMismatch):
        e.execute_insert_batch("INSERT INTO t VALUES (1); INSERT INTO t VALUES ('x')")
    with pytest.raises(InsertOnlyStatementRequired):
        e.execute_insert_batch("INSERT INTO t VALUES (1); SELECT a FROM t")
    assert rows(e, "SELECT COUNT(*) FROM t") == [(0,)]
    with pytest.raises(SqlError):
        e.execute("INSERT INTO t VALUES (1); SELEC")
    assert rows(e, "SELECT COUNT(*) FROM t") == [(0,)]
    shared = SharedEngine(e)
    assert shared.execute_insert_batch("INSERT INTO t VALUES (1), (2)") == 2
    with shared._writing(True), pytest.raises(DatabaseBusy):
        shared.try_query("SELECT a FROM t")


def test_limits_are_inclusive(spark):
    e = Engine(spark, QueryLimits(max_rows=2, max_values=4, max_groups=2, max_scan_rows=3), TableLimits(max_rows=4, max_columns=2))
    e.execute("CREATE TABLE t (a Int64, b Int64); INSERT INTO t VALUES (1, 1), (2, 2), (3, 3)")
    assert len(rows(e, "SELECT a, b FROM t LIMIT 2")) == 2
    for bad in ("SELECT a FROM t", "SELECT a, b, a FROM t LIMIT 2", "SELECT a, COUNT(*) FROM t GROUP BY a"):
        with pytest.raises(ResourceLimitExceeded):
            rows(e, bad)
    e.execute("INSERT INTO t VALUES (4, 4)")
    for bad in ("INSERT INTO t VALUES (5, 5)", "ALTER TABLE t ADD COLUMN c Int64", "SELECT a FROM t LIMIT 1"):
        with pytest.raises(ResourceLimitExceeded):
            e.execute(bad)
    assert QueryLimits().tighten(max_rows=5, max_groups=0).max_rows == 5 and QueryLimits().tighten(max_rows=10**9).max_rows == 10_000
    with pytest.raises(StatementLimitExceeded):
        parse(";".join(["SELECT 1"] * 3), SqlLimits(max_statements=2))
    deep = "(" * 64 + "i = 1" + ")" * 64
    with pytest.raises(SqlError):
        parse(f"SELECT i FROM t WHERE {deep}")
    parse("SELECT i FROM t WHERE " + deep[1:-1])
    with pytest.raises(SqlError):
        parse("SELECT i FROM t WHERE " + " AND ".join(["i = 1"] * 200))


def test_malformed_scripts_raise_typed_errors():
    rnd = random.Random(0xD1CE)
    words = "SELECT FROM WHERE GROUP BY ORDER LIMIT t a b , ( ) * = <= 'x' 1 2.5 NOT AND OR IN LIKE BETWEEN IS NULL UNION ALL CAST AS Int64 COUNT ROW_NUMBER OVER INSERT INTO VALUES CREATE TABLE ; - -- '".split()
    for _ in range(3000):
        text = " ".join(rnd.choices(words, k=rnd.randrange(1, 25)))
        try:
            parse(text)
        except (SqlError, InvalidQuery, ReservedIdentifier):
            pass
    for good in ("SELECT a FROM t -- comment\n;", ";;", "select a from t where a=1 or (not b='x' and c>=-2.5e-3)"):
        parse(good)
    with pytest.raises(SqlError, match="byte 7 of"):
        parse("SELECT ,")
    assert math.isfinite(parse("SELECT 1.5e300")[0].value) and Command(lambda: 3).rows == 3


def test_sums_of_more_than_two_to_the_31_rows(spark):
    e = Engine.over(spark, {"t": spark.range(0, 2_200_000_000, 1, 8).selectExpr("-1L as x")})
    assert e.query("SELECT SUM(x), AVG(x) FROM t").rows() == [(-2_200_000_000, -1.0)]


def test_numbering_of_one_key_in_all_rows_uses_several_tasks(spark):
    df = spark.range(0, 50_000, 1, 4).selectExpr("7L as k", "id as v")
    e = Engine.over(spark, {"t": df})
    found = e.frame("SELECT v, ROW_NUMBER() OVER (ORDER BY k DESC) AS n FROM t")
    assert sorted(r["n"] for r in found.collect()) == list(range(1, 50_001))
    seen = []
    numbered(df, [F.col("k").asc(), F.col("v").asc()], lambda x, _: seen.append(x.cache()) or seen[-1], "n").count()
    assert seen[0].groupBy(F.shiftright("__at", 33)).count().count() > 1


def test_texts_of_floats(spark):
    values = [0.1, 1.0, -0.0, 1e22, 1.5e300, 5e-324, 123456789.125, -1e-7, None, 2.0**63, 1e16, 0.30000000000000004]
    e = Engine.over(spark, {"t": spark.createDataFrame([(x,) for x in values], "x double")})
    got = [r[0] for r in e.query("SELECT CAST(x AS String) FROM t").rows()]
    for x, text in zip(values, got):
        assert (text is None) == (x is None) and (x is None or float(text) == x and "e" not in text and not text.endswith("."))
    assert got[:3] == ["0.1", "1", "-0"] and got[3] == "1" + "0" * 22


def test_nulls_are_placed_where_a_query_says(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE t (c Int64 NULL); INSERT INTO t VALUES (2), (NULL), (1)")
    for order, want in (("ASC NULLS LAST", [1, 2, None]), ("DESC NULLS FIRST", [None, 2, 1]), ("ASC NULLS FIRST", [None, 1, 2]), ("DESC", [2, 1, None])):
        assert [r[0] for r in e.query(f"SELECT c FROM t ORDER BY c {order} LIMIT 3").rows()] == want
    with pytest.raises(SqlError):
        e.query("SELECT c FROM t ORDER BY c NULLS LIMIT 1")
