"""Queries and inserts over HTTP, with per-request limits, output formats, metrics and bearer or key authentication.

POST / and /query take a query as the body, GET and POST /?query= as a parameter; POST /insert takes a batch of INSERTs,
POST /insert/<table> and POST /?query=INSERT INTO <table> FORMAT <format> take rows. /ping, /ready and /metrics say how the
server is. Requests never wait for a lock: a busy database answers 503.
"""

from __future__ import annotations

import hmac
import re
import threading
import uuid
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine, SharedEngine
from .errors import DatabaseBusy, EngineError, InvalidQuery, typed
from .plans.metadata import PREFIX, value_bytes
from .sources import formats, ingest

#: Output formats by their names in requests, as (format, header).
OUTPUT = {
    "JSON": ("json", True),
    "CSV": ("csv", False),
    "CSVWithNames": ("csv", True),
    "TabSeparated": ("tsv", False),
    "TabSeparatedWithNames": ("tsv", True),
    "JSONEachRow": ("jsoneachrow", True),
    "JSONCompactEachRow": ("jsoncompacteachrow", True),
}
INPUT = {"CSV": ingest.csv, "CSVWithNames": ingest.csv_with_names, "TabSeparated": ingest.tsv, "TabSeparatedWithNames": ingest.tsv_with_names}
LIMITS = {
    "max_result_rows": "max_rows",
    "max_result_values": "max_values",
    "max_result_bytes": "max_bytes",
    "max_rows_to_read": "max_scan_rows",
    "max_rows_to_group_by": "max_groups",
    "max_group_key_cells": "max_group_key_cells",
    "max_group_key_bytes": "max_group_key_bytes",
    "max_ordering_state_bytes": "max_ordering_state_bytes",
    "max_aggregate_state_cells": "max_aggregate_state_cells",
    "max_aggregate_state_bytes": "max_aggregate_state_bytes",
}
KNOWN = {*LIMITS, "query", "default_format", "database", "max_threads", "readonly"}
TERMINAL = re.compile(r"\A(.*\S)\s+FORMAT\s+([A-Za-z]+)\s*;?\s*\Z", re.DOTALL | re.IGNORECASE)
INSERT = re.compile(r"\A\s*INSERT\s+INTO\s+([A-Za-z_][A-Za-z0-9_]*)\s+FORMAT\s+([A-Za-z]+)\s*;?\s*\Z", re.IGNORECASE)
FORMAT_HEADER = "X-ClickHouse-Format"
MAX_BODY = 64 << 20


@dataclass(frozen=True)
class Principal:
    name: str
    token: str
    writes: bool = True


class Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Service:
    """What the server does, without sockets."""

    def __init__(self, engine: Engine, principals: tuple[Principal, ...] = ()):
        if len(principals) > 64:
            raise InvalidQuery("at most 64 principals")
        self.shared, self.principals = SharedEngine(engine), principals
        self.counts = {"queries": 0, "inserts": 0, "errors": 0}
        self.lock = threading.Lock()

    def counted(self, what: str) -> None:
        with self.lock:
            self.counts[what] += 1

    def who(self, authorization: str | None, key: str | None) -> Principal | None:
        """The principal of a token. All are compared in full, so the time says nothing about them."""
        if not self.principals:
            return Principal("", "")
        given = (authorization or "").removeprefix("Bearer ") if authorization else key or ""
        found = None
        for p in self.principals:
            if hmac.compare_digest(p.token.encode(), given.encode()):
                found = p
        return found

    def output(self, query: str, params: dict[str, str], header: str | None) -> tuple[str, tuple[str, bool]]:
        """The query without its FORMAT clause, and the format; more than one way of asking is an error."""
        clause = TERMINAL.match(query)
        asked = [x for x in (clause and clause[2], header, params.get("default_format")) if x]
        if len(asked) > 1:
            raise Refused(400, "the output format is given twice")
        if not asked:
            return query, OUTPUT["JSON"]
        by_case = {k.lower(): v for k, v in OUTPUT.items()} if clause else OUTPUT
        found = by_case.get(asked[0].lower() if clause else asked[0])
        if found is None:
            raise Refused(400, f"unknown output format '{asked[0]}'")
        return clause[1] if clause else query, found

    def query(self, text: str, params: dict[str, str], header: str | None) -> str:
        text, (name, with_header) = self.output(text, params, header)
        limits = self.shared.engine.limits.tighten(**{LIMITS[k]: whole(k, v) for k, v in params.items() if k in LIMITS})
        self.counted("queries")
        return formats.written(self.shared.try_query(text, limits), name, with_header, limits.max_bytes)

    def rows(self, table: str, name: str, body: bytes) -> int:
        if name not in INPUT:
            raise Refused(400, f"unknown input format '{name}'")
        self.counted("inserts")
        return self.shared.ingest(INPUT[name], table, body, wait=False)

    def metrics(self) -> str:
        tables = self.shared.engine.catalog.all()
        out = [(f"{PREFIX}_tables", "gauge", {"": len(tables)}), *((f"{PREFIX}_http_{k}_total", "counter", {"": v}) for k, v in self.counts.items())]
        out += [(f"{PREFIX}_table_rows", "gauge", {f'{{table="{e.name}"}}': e.count() for e in tables}), (f"{PREFIX}_table_value_bytes", "gauge", {f'{{table="{e.name}"}}': value_bytes(e) for e in tables})]
        return "".join(f"# TYPE {n} {k}\n" + "".join(f"{n}{label} {v}\n" for label, v in values.items()) for n, k, values in out)

    def answer(self, method: str, target: str, headers: dict[str, str], body: bytes) -> tuple[int, str]:
        url = urlsplit(target)
        given = parse_qs(url.query, keep_blank_values=True, strict_parsing=False)
        try:
            if url.path in ("/ping", "/ready", "/metrics"):
                if method != "GET":
                    raise Refused(405, "only GET")
                return 200, self.metrics() if url.path == "/metrics" else "Ok.\n"
            principal = self.who(headers.get("authorization"), headers.get("x-clickhouse-key"))
            if principal is None:
                raise Refused(401, "authentication failed")
            if headers.get("expect"):
                raise Refused(417, "Expect is not supported")
            if any(len(v) > 1 for v in given.values()):
                raise Refused(400, "a parameter is given twice")
            params = {k: v[0] for k, v in given.items()}
            for k in params:
                if k not in KNOWN:
                    raise Refused(400, f"unknown parameter '{k}'")
            if params.get("database", "default") != "default" or headers.get("x-clickhouse-database", "default") != "default":
                raise Refused(400, "unknown database")
            for k in ("max_threads", "readonly"):
                if k in params:
                    whole(k, params[k])
            if url.path.startswith("/insert"):
                return self.insert(method, url.path, principal, headers, body)
            if url.path not in ("/", "/query"):
                raise Refused(404, "no such route")
            if method not in ("GET", "POST") or method == "GET" and url.path == "/query":
                raise Refused(405, "method not allowed")
            if "query" in params:
                if found := INSERT.match(params["query"]):
                    self.may_write(principal, params, method)
                    return 200, f"{self.rows(found[1], found[2], body)}\n"
                if body.strip():
                    raise Refused(400, "the query is given twice")
                return 200, self.query(params["query"], params, headers.get(FORMAT_HEADER.lower()))
            if method == "GET":
                raise Refused(400, "the query is missing")
            return 200, self.query(text_of(body), params, headers.get(FORMAT_HEADER.lower()))
        except Refused as e:
            self.counted("errors")
            return e.status, f"{e}\n"
        except DatabaseBusy as e:
            self.counted("errors")
            return 503, f"{e}\n"
        except Exception as e:
            self.counted("errors")
            if isinstance(e := typed(e), EngineError):
                return 400, f"{e}\n"
            raise

    def may_write(self, principal: Principal, params: dict[str, str], method: str) -> None:
        if method != "POST":
            raise Refused(405, "only POST")
        if not principal.writes or params.get("readonly", "0") != "0":
            raise Refused(403, "read only")

    def insert(self, method: str, path: str, principal: Principal, headers: dict[str, str], body: bytes) -> tuple[int, str]:
        self.may_write(principal, {}, method)
        if path == "/insert":
            self.counted("inserts")
            return 200, f"{self.shared.try_execute_insert_batch(text_of(body))}\n"
        table = path.removeprefix("/insert/")
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", table):
            raise Refused(404, "no such route")
        return 200, f"{self.rows(table, headers.get(FORMAT_HEADER.lower(), 'CSV'), body)}\n"


def whole(name: str, text: str) -> int:
    if not re.fullmatch(r"[0-9]{1,18}", text):
        raise Refused(400, f"parameter '{name}' must be a whole number")
    return int(text)


def text_of(body: bytes) -> str:
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        raise Refused(400, "the body is not UTF-8") from None


def server(engine: Engine, port: int, principals: tuple[Principal, ...] = (), host: str = "127.0.0.1", timeout: float = 30.0, max_requests: int = 32, deadline: float = 300.0) -> ThreadingHTTPServer:
    """A server that answers at most max_requests at once (others get 503), and none for longer than deadline seconds: then its
    Spark jobs are cancelled and the answer is 504. timeout is for a client that sends nothing."""
    service, places, sc = Service(engine, principals), threading.BoundedSemaphore(max_requests), engine.spark.sparkContext

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            self.timeout = timeout
            super().setup()

        def handle_any(self):
            if not places.acquire(blocking=False):
                self.say(503, "too many requests at once\n")
                return
            try:
                self.say(*self.timed())
            finally:
                places.release()

        def timed(self) -> tuple[int, str]:
            group, late = f"http-{uuid.uuid4().hex}", threading.Event()

            def stop():
                late.set()
                sc.cancelJobGroup(group)

            timer = threading.Timer(deadline, stop)
            timer.start()
            status, text = 500, ""
            try:
                sc.setJobGroup(group, "an HTTP request", True)
                status, text = self.answered()
            except Exception:
                if not late.is_set():
                    raise
            finally:
                timer.cancel()
            return (504, "the deadline has passed\n") if late.is_set() else (status, text)

        def answered(self) -> tuple[int, str]:
            length = self.headers.get("Content-Length", "0")
            if not length.isdigit() or int(length) > MAX_BODY:
                return 400, "the body is too long\n"
            return service.answer(self.command, self.path, {k.lower(): v for k, v in self.headers.items()}, self.rfile.read(int(length)))

        def say(self, status: int, text: str) -> None:
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Connection", "close")
            self.end_headers()
            self.wfile.write(data)
            self.close_connection = True

        do_GET = do_POST = do_PUT = do_DELETE = handle_any  # noqa: N815

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(engine: Engine, port: int, **more) -> None:
    with server(engine, port, **more) as s:
        s.serve_forever()
