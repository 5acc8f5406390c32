"""Formats, imports, snapshots, the command line and HTTP."""

import io
import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F
from stratalith import cli
from stratalith.catalog import entry_of
from stratalith.engine import Engine
from stratalith.errors import ImportFailed, InvalidQuery, ResourceLimitExceeded
from stratalith.http_server import Principal, Service, server
from stratalith.limits import QueryLimits
from stratalith.sources import formats, ingest, persist


@pytest.fixture()
def db(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE metrics (id Int64, score Float64, active Bool, label String); INSERT INTO metrics VALUES (11, -0.25, false, 'north, south'), (12, 3.0, true, 'so-called \"east\"'), (13, 1e3, false, 'west | up')")
    e.execute("CREATE TABLE n (v Nullable(Int64)); INSERT INTO n VALUES (7), (NULL), (-2)")
    return e


def test_output_formats(db):
    q = db.query("SELECT id, score, active, label FROM metrics")
    assert formats.written(q, "CSV") == 'id,score,active,label\n11,-0.25,false,"north, south"\n12,3.0,true,"so-called ""east"""\n13,1000.0,false,west | up\n'
    assert formats.written(db.query("SELECT v FROM n"), "tsv") == "v\n7\n\\N\n-2\n"
    assert formats.written(db.query("SELECT v FROM n"), "csv", header=False) == "7\nNULL\n-2\n"
    assert json.loads(formats.written(q, "json")) == {"columns": [{"name": "id", "type": "Int64"}, {"name": "score", "type": "Float64"}, {"name": "active", "type": "Bool"}, {"name": "label", "type": "String"}], "rows": [[11, -0.25, False, "north, south"], [12, 3.0, True, 'so-called "east"'], [13, 1000.0, False, "west | up"]]}
    assert formats.written(db.query("SELECT v FROM n"), "JSONEachRow") == '{"v":7}\n{"v":null}\n{"v":-2}\n'
    assert formats.written(db.query("SELECT v AS v FROM n LIMIT 1"), "jsoncompacteachrow") == "[7]\n"
    assert formats.written(db.query("SELECT v FROM n"), "table") == "+------+\n| v    |\n+------+\n| 7    |\n| NULL |\n| -2   |\n+------+\n"
    assert formats.written(db.query("SELECT v FROM n WHERE v = 0"), "table") == "+---+\n| v |\n+---+\n"
    with pytest.raises(ResourceLimitExceeded):
        formats.written(q, "csv", max_bytes=10)
    with pytest.raises(InvalidQuery):
        formats.written(q, "xml")


def test_imports(db):
    assert ingest.csv_with_names(db, "metrics", b'label,id\r\n"a ""b"",\n c",-5\r\nNULL,6\r\n') == 2
    assert db.query("SELECT id, score, active, label FROM metrics WHERE id < 0 OR id = 6").rows() == [(-5, 0.0, False, 'a "b",\n c'), (6, 0.0, False, "NULL")]
    assert ingest.csv(db, "n", b'NULL\n8\n') == 2
    assert ingest.tsv(db, "metrics", b"9\t-3e2\tTRUE\ttab\\there\\\\\n") == 1
    assert db.query("SELECT score, active, label FROM metrics WHERE id = 9").rows() == [(-300.0, True, "tab\there\\")]
    assert ingest.tsv_with_names(db, "n", b"v\n\\N\n5\n") == 2
    assert ingest.json_compact_each_row(db, "n", b"[1]\n[null]\n") == 2
    before = db.query("SELECT COUNT(*) FROM metrics").rows()
    for reader, table, data in (
        (ingest.csv, "metrics", b"1,1.5,true,x\n2,oops,true,y\n"), (ingest.csv, "metrics", b"1,2\n"), (ingest.csv, "metrics", b'1,1.5,true,"x\n'), (ingest.csv_with_names, "metrics", b"ID\n1\n"),
        (ingest.csv_with_names, "metrics", b"id,id\n1,1\n"), (ingest.csv_with_names, "metrics", b""), (ingest.csv, "n", b'"NULL"\n'), (ingest.tsv, "metrics", b"1\t1.5\ttrue\tbad\\x\n"),
        (ingest.json_compact_each_row, "n", b"[1.5]\n"), (ingest.json_compact_each_row, "n", b"[1,2]\n"), (ingest.json_compact_each_row, "metrics", b"[1]\n"), (ingest.csv, "n", b"\xff\n"),
    ):
        with pytest.raises(ImportFailed):
            reader(db, table, data)
    assert db.query("SELECT COUNT(*) FROM metrics").rows() == before


def test_files_of_any_size(db, tmp_path):
    (tmp_path / "a.csv").write_text("id,score,active,label\n1,2.5,true,x\n2,1e3,false,\"y,z\"\n")
    assert [tuple(r) for r in ingest.from_csv_files(db, "metrics", str(tmp_path / "a.csv")).collect()] == [(1, 2.5, True, "x"), (2, 1000.0, False, "y,z")]
    formats.save(db.query("SELECT v FROM n"), str(tmp_path / "out"), "csv")
    assert db.spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_appending_files_takes_all_lines_or_none(db, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.txt").write_text('5,1.5,true,"NULL"\n6,2.5,false,NULL\n7,1e2,TRUE,"x, ""y"""\n')
    assert ingest.append_files(db, "metrics", str(tmp_path / "a"), "csv") == 3
    assert db.query("SELECT id, score, label FROM metrics WHERE id < 10 ORDER BY id").rows() == [(5, 1.5, "NULL"), (6, 2.5, "NULL"), (7, 100.0, 'x, "y"')]
    (tmp_path / "n.txt").write_text('NULL\n4\n"5"\n')
    assert ingest.append_files(db, "n", str(tmp_path / "n.txt"), "csv") == 3
    assert db.query("SELECT v FROM n").rows() == [(7,), (None,), (-2,), (None,), (4,), (5,)]
    for kind, text in (("csv", "1\nx\n"), ("csv", '"NULL"\n'), ("tsv", "1\t2\n"), ("tsv", "\\q\n"), ("jsoncompacteachrow", "[1]\n[1.5]\n"), ("csv", "99999999999999999999\n")):
        (tmp_path / "bad.txt").write_text(text)
        with pytest.raises(ImportFailed):
            ingest.append_files(db, "n", str(tmp_path / "bad.txt"), kind)
    assert db.query("SELECT COUNT(*) FROM n").rows() == [(6,)]
    with pytest.raises(InvalidQuery):
        ingest.append_files(db, "n", str(tmp_path / "n.txt"), "xml")


def test_the_server_has_places_and_a_deadline(db):
    db.limits = QueryLimits.none()
    db.catalog.add(entry_of("big", db.spark.range(0, 10**12, 1, 8).toDF("id")))
    with server(db, 0, max_requests=1, deadline=4.0) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        at, found = f"http://127.0.0.1:{http.server_address[1]}/", []

        def ask(body):
            try:
                with urllib.request.urlopen(urllib.request.Request(at, data=body), timeout=60) as r:
                    found.append(r.status)
            except urllib.error.HTTPError as e:
                found.append(e.code)

        slow = threading.Thread(target=ask, args=(b"SELECT SUM(id) FROM big",))
        slow.start()
        time.sleep(1)
        ask(b"SELECT v FROM n")
        slow.join()
        ask(b"SELECT v FROM n")
        assert found == [503, 504, 200]
        http.shutdown()


def test_snapshots(spark, db, tmp_path):
    folder = f"file://{tmp_path}/snap"
    persist.save(db, folder)
    with pytest.raises(InvalidQuery):
        persist.save(db, folder)
    db.execute("INSERT INTO n VALUES (99)")
    persist.save(db, folder, replace=True)
    fresh = Engine(spark)
    assert persist.restore(fresh, folder) == ["metrics", "n"] and fresh.query("SELECT v FROM n").rows() == [(7,), (None,), (-2,), (99,)]
    fresh.execute("INSERT INTO n VALUES (100)")
    assert fresh.query("SELECT v FROM n LIMIT 1 OFFSET 4").rows() == [(100,)]
    (tmp_path / "snap/manifest.json").write_text('{"crc": 1, "tables": "[]"}')
    again = Engine(spark)
    persist.restore(again, folder)
    assert again.query("SELECT COUNT(*) FROM n").rows() == [(3,)]  # the backup


def test_log(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    e = Engine(spark)
    e.execute("CREATE TABLE n (v Nullable(Int64))")
    log = persist.Log(e, folder, "n")
    assert log.append([(1,), (None,)]) == 2 and log.append([(3,)]) == 1
    (tmp_path / "log/2").mkdir()  # a torn tail

    def replayed():
        fresh = Engine(spark)
        fresh.execute("CREATE TABLE n (v Nullable(Int64))")
        persist.Log(fresh, folder, "n").replay()
        return fresh.query("SELECT v FROM n").rows()

    assert replayed() == [(1,), (None,), (3,)]
    (tmp_path / "log/0.json").write_text("{}")
    with pytest.raises(InvalidQuery):
        replayed()


def test_range_partitions(spark, db, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    ranges = [(0, 29), (30, 59), (60, 99)]
    persist.write_ranges(df, "k", ranges, str(tmp_path / "r"))
    got = persist.read_ranges(db, "k", ranges, str(tmp_path / "r"), 25, 35)
    assert sorted(r["k"] for r in got.collect()) == list(range(25, 36)) and got.columns == ["k", "v"]
    assert len(got.inputFiles()) >= 2
    with pytest.raises(InvalidQuery):
        persist.write_ranges(df, "k", [(0, 50), (40, 99)], str(tmp_path / "x"))
    with pytest.raises(InvalidQuery):
        persist.write_ranges(df, "k", [(0, 50)], str(tmp_path / "y"))


def test_command_line(spark, db, capsys):
    out = io.StringIO()
    assert cli.run_script(db, b"SELECT v FROM n; INSERT INTO n VALUES (1); SELECT COUNT(*) FROM n", "table", out) == 0
    assert out.getvalue().endswith("+------+\n\n+----------+\n| COUNT(*) |\n+----------+\n| 4        |\n+----------+\n")
    out = io.StringIO()
    assert cli.run_script(db, b"SELECT v FROM n LIMIT 1; SELECT x FROM n", "csv", out) == 1 and out.getvalue() == "v\n7\n"
    assert "no column 'x'" in capsys.readouterr().err
    assert cli.run_script(db, b"INSERT INTO n VALUES (5); SELEC", "csv", io.StringIO()) == 1
    assert db.query("SELECT COUNT(*) FROM n").rows() == [(4,)]
    out = io.StringIO()
    assert cli.run_session(db, ["SELECT v FROM n ORDER BY v DESC LIMIT 3\n", "\n", "INSERT INTO n VALUES (2)\n"], out) == 0 and out.getvalue() == "[7, 1, -2]\n"


def test_http_answers(db):
    s = Service(db, (Principal("r", "read", False), Principal("w", "write")))
    ask = lambda method, target, body=b"", **h: s.answer(method, target, {"authorization": "Bearer write"} | h, body)
    assert ask("POST", "/", b"SELECT v FROM n LIMIT 1") == (200, '{"columns":[{"name":"v","type":"Int64"}],"rows":[[7]]}\n')
    assert ask("GET", "/?query=SELECT+v+FROM+n+LIMIT+1+format+csvwithnames") == (200, "v\n7\n")
    assert ask("POST", "/query?default_format=TabSeparated", b"SELECT v FROM n") == (200, "7\n\\N\n-2\n")
    assert ask("POST", "/insert", b"INSERT INTO n VALUES (1), (2)") == (200, "2\n")
    assert ask("POST", "/insert/n", b"NULL\n4\n") == (200, "2\n")
    assert ask("POST", "/?query=INSERT+INTO+n+FORMAT+TabSeparatedWithNames", b"v\n6\n") == (200, "1\n")
    assert ask("POST", "/?max_result_rows=2", b"SELECT v FROM n")[0] == 400
    assert ask("GET", "/ping", authorization="")[0] == 200 and "stratalith_table_rows{table=\"n\"} 8" in ask("GET", "/metrics")[1]
    for status, method, target, body, headers in (
        (401, "POST", "/", b"SELECT 1", {"authorization": "Bearer no"}), (403, "POST", "/insert", b"INSERT INTO n VALUES (1)", {"authorization": "Bearer read"}),
        (404, "GET", "/nothing", b"", {}), (405, "PUT", "/", b"", {}), (405, "GET", "/insert/n", b"", {}), (400, "GET", "/", b"", {}), (400, "POST", "/?nonsense=1", b"SELECT 1", {}),
        (400, "POST", "/?default_format=csv", b"SELECT 1", {}), (400, "POST", "/?default_format=CSV", b"SELECT 1 FORMAT CSV", {}), (400, "POST", "/?database=other", b"SELECT 1", {}),
        (400, "POST", "/", b"INSERT INTO n VALUES (1)", {}), (400, "POST", "/", b"SELEC", {}), (417, "POST", "/", b"SELECT 1", {"expect": "100-continue"}), (400, "POST", "/", b"\xff", {}),
    ):
        assert ask(method, target, body, **headers)[0] == status, (method, target, body)
    with s.shared._writing(True):
        assert ask("POST", "/", b"SELECT v FROM n")[0] == 503


def test_http_server(db):
    with server(db, 0) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{http.server_address[1]}"
        with urllib.request.urlopen(urllib.request.Request(f"{at}/", data=b"SELECT v FROM n FORMAT JSONEachRow"), timeout=60) as r:
            assert r.read() == b'{"v":7}\n{"v":null}\n{"v":-2}\n' and r.headers["Connection"] == "close"
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(f"{at}/?query=nonsense", timeout=60)
        assert e.value.code == 400
        http.shutdown()


def test_tables_over_files(spark):
    e = Engine(spark)
    e.catalog.add(entry_of("region", spark.read.parquet("/root/testdata/sf0.001/region.parquet")))
    assert e.query("SELECT COUNT(*) FROM region").rows() == [(5,)] and [f.declared for f in e.catalog.get("region").fields] == ["Nullable(Int64)", "String"]
