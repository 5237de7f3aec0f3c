"""HTTP front end on the standard library: one Spark session, one lock for each database, JSON in and out."""

from __future__ import annotations

import argparse
import json
import logging
import os
import re
import threading
import uuid
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.sql import SparkSession

from . import __version__
from .errors import DialectError
from .plans import ast
from .plans.parser import parse
from .session import Database, default_session
from .sources.filesystem import Files
from .sources.store import FORMAT, MANIFEST

API_VERSION = "v1"
LOG = logging.getLogger(__name__)
_NAME = re.compile(r"[A-Za-z0-9_-]+")


class HttpError(Exception):
    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.status, self.code = status, code


# HTTP status of each error code; others are 400.
STATUS = {
    "UNKNOWN_TABLE": 404, "UNKNOWN_COLUMN": 404, "CONFLICT": 409, "UNIQUE_VIOLATION": 409, "NOT_NULL_VIOLATION": 409, "FOREIGN_KEY_VIOLATION": 409,
    "DUPLICATE_INDEX": 409, "STORAGE_ERROR": 500,
}


@dataclass
class Config:
    """Settings; a file is read first, then the environment, then arguments."""

    data_dir: str = "./lodestone-data"
    database: str = "default"
    host: str = "127.0.0.1"
    port: int = 8080
    token: str | None = None
    timeout_s: float = 30.0  # how long a request waits for its database

    @staticmethod
    def load(args: list[str] | None = None) -> Config:
        p = argparse.ArgumentParser(prog="lodestone-server")
        p.add_argument("--config")
        names = {"data_dir": str, "database": str, "host": str, "port": int, "token": str, "timeout_s": float}
        for n, kind in names.items():
            p.add_argument("--" + n.replace("_", "-"), type=kind)
        given = vars(p.parse_args(args))
        values: dict = {}
        if path := given.pop("config") or os.environ.get("LODESTONE_CONFIG"):
            with open(path) as f:
                values |= {k: v for k, v in json.load(f).items() if k in names}
        values |= {n: kind(v) for n, kind in names.items() if (v := os.environ.get(f"LODESTONE_{n.upper()}"))}
        return Config(**values | {k: v for k, v in given.items() if v is not None})

    def shown(self) -> dict:
        return vars(self) | {"token": "set" if self.token else None}


@dataclass
class Handle:
    name: str
    database: Database
    lock: threading.Lock = field(default_factory=threading.Lock)


class Service:
    """What the routes do, apart from HTTP."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.root = Files(spark, config.data_dir)
        self.root.make("")
        self.guard = threading.Lock()
        self.open: dict[str, Handle] = {}
        self.sessions: dict[str, Handle] = {}
        self.counts = {"requests": 0, "failed": 0, "sessions_created": 0, "transactions_committed": 0, "transactions_rolled_back": 0}
        if not self.root.exists(f"{config.database}/{MANIFEST}"):
            Database(spark, self.root.full(config.database))

    # -- databases

    def names(self) -> list[str]:
        return [n for n in self.root.names() if self.root.exists(f"{n}/{MANIFEST}")]

    def _known(self, name: str) -> None:
        if not _NAME.fullmatch(name):
            raise HttpError(400, "INVALID_DATABASE_NAME", f"'{name}' is no database name")
        if not self.root.exists(f"{name}/{MANIFEST}"):
            raise HttpError(404, "DATABASE_NOT_FOUND", f"There is no database '{name}'")

    def handle(self, name: str) -> Handle:
        self._known(name)
        with self.guard:
            if name not in self.open:
                self.open[name] = Handle(name, Database(self.spark, self.root.full(name)))
            return self.open[name]

    def create(self, name: str) -> dict:
        if not _NAME.fullmatch(name or ""):
            raise HttpError(400, "INVALID_DATABASE_NAME", f"'{name}' is no database name")
        if self.root.exists(f"{name}/{MANIFEST}"):
            raise HttpError(409, "DATABASE_ALREADY_EXISTS", f"Database '{name}' exists")
        Database(self.spark, self.root.full(name))
        return {"database": name, "created": True}

    def drop(self, name: str) -> dict:
        self._known(name)
        if name == self.config.database:
            raise HttpError(403, "DATABASE_DELETE_DENIED", "The default database stays")
        with self.guard:
            if any(h.name == name for h in self.sessions.values()):
                raise HttpError(409, "DATABASE_IN_USE", f"Database '{name}' has open sessions")
            self.open.pop(name, None)
            self.root.delete(name)
        return {"database": name, "deleted": True}

    def import_(self, name: str, package: dict, overwrite: bool) -> dict:
        """The package is loaded beside the old database, which goes only when the new one is whole."""
        if not _NAME.fullmatch(name):
            raise HttpError(400, "INVALID_DATABASE_NAME", f"'{name}' is no database name")
        if self.root.exists(f"{name}/{MANIFEST}") and not overwrite:
            raise HttpError(409, "DATABASE_ALREADY_EXISTS", f"Database '{name}' exists")
        part = f".import-{uuid.uuid4().hex}"
        try:
            Database(self.spark, self.root.full(part)).import_json(package)
            with self.guard:
                self.open.pop(name, None)
                self.root.delete(name)
                self.root.fs.rename(self.root._path(part), self.root._path(name))
        finally:
            self.root.delete(part)
        return {"database": name, "imported": True}

    # -- statements

    def _locked(self, h: Handle, action, timeout_ms: int | None = None):
        if not h.lock.acquire(timeout=self.config.timeout_s if timeout_ms is None else timeout_ms / 1000):
            raise HttpError(400, "TIMEOUT", "The database is busy")
        try:
            return action(h.database)
        finally:
            h.lock.release()

    def execute(self, name: str, sql: str, timeout_ms: int | None = None) -> dict:
        statement = self._stateless(sql)
        return self._locked(self.handle(name), lambda db: db.run(statement).to_json(), timeout_ms)

    @staticmethod
    def _stateless(sql: str) -> ast.Statement:
        statement = parse(sql)
        if isinstance(statement, ast.Transaction):
            raise HttpError(400, "TRANSACTION_REQUIRES_SESSION", "Transactions need a session")
        return statement

    def batch(self, statements: list[str], timeout_ms: int | None = None) -> dict:
        """In order, until one fails; those before it stay."""
        done: list[dict] = []
        for i, sql in enumerate(statements):
            try:
                done.append(self.execute(self.config.database, sql, timeout_ms))
            except (DialectError, HttpError) as e:
                return {"results": done, "failed_at": i, "error": {"code": e.code, "message": str(e)}}
        return {"results": done}

    # -- sessions

    def start(self, name: str) -> dict:
        self._known(name)
        key = uuid.uuid4().hex
        with self.guard:
            self.sessions[key] = Handle(name, Database(self.spark, self.root.full(name)))
            self.counts["sessions_created"] += 1
        return {"session_id": key, "database": name}

    def session(self, key: str, name: str | None) -> Handle:
        with self.guard:
            h = self.sessions.get(key)
        if h is None or name is not None and h.name != name:
            raise HttpError(404, "SESSION_NOT_FOUND", "There is no such session")
        return h

    def end(self, key: str, name: str | None) -> dict:
        h = self.session(key, name)
        if h.database.in_transaction:
            raise HttpError(409, "SESSION_HAS_ACTIVE_TRANSACTION", "The session's transaction is open")
        with self.guard:
            self.sessions.pop(key, None)
        return {"session_id": key, "deleted": True}

    def in_session(self, key: str, name: str | None, sql: str, timeout_ms: int | None = None) -> dict:
        statement = parse(sql)
        out = self._locked(self.session(key, name), lambda db: db.run(statement).to_json(), timeout_ms)
        if isinstance(statement, ast.Transaction) and statement.action != "begin":
            self.counts["transactions_committed" if statement.action == "commit" else "transactions_rolled_back"] += 1
        return out

    # -- routes: (method, pattern, action of the match, the body and the service)

    def routes(self):
        default = self.config.database

        def sql(body: dict) -> str:
            if not isinstance(body.get("sql"), str):
                raise HttpError(400, "INVALID_REQUEST", "The body needs 'sql'")
            return body["sql"]

        def wait(body: dict) -> int | None:
            """`timeout_ms` of a request; its `idempotency_key` goes to the log, repeated writes run again."""
            if body.get("idempotency_key") is not None:
                LOG.info("idempotency key %r", str(body["idempotency_key"]))
            found = body.get("timeout_ms")
            if found is not None and (not isinstance(found, int) or isinstance(found, bool) or found < 0):
                raise HttpError(400, "INVALID_REQUEST", "'timeout_ms' is a number of milliseconds")
            return found

        def statements(body: dict) -> list[str]:
            found = body.get("statements")
            if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
                raise HttpError(400, "INVALID_REQUEST", "The body needs 'statements'")
            return found

        def admin(action):
            return self._locked(self.handle(default), action)

        version = {"server": __version__, "api": API_VERSION, "storage_format": FORMAT}
        return [
            ("GET", "/health", lambda m, b: {"status": "ok"}),
            ("GET", "/version", lambda m, b: version),
            ("GET", "/databases", lambda m, b: {"databases": self.names()}),
            ("POST", "/databases", lambda m, b: self.create(b.get("name", ""))),
            ("DELETE", "/databases/([^/]+)", lambda m, b: self.drop(m[1])),
            ("GET", "/databases/([^/]+)/export", lambda m, b: self._locked(self.handle(m[1]), lambda db: db.export_json())),
            ("POST", "/databases/([^/]+)/import", lambda m, b: self.import_(m[1], b.get("package", b), bool(b.get("overwrite")))),
            ("POST", "/databases/([^/]+)/execute", lambda m, b: self.execute(m[1], sql(b), wait(b))),
            ("POST", "/databases/([^/]+)/session", lambda m, b: self.start(m[1])),
            ("DELETE", "/databases/([^/]+)/session/([^/]+)", lambda m, b: self.end(m[2], m[1])),
            ("POST", "/databases/([^/]+)/session/([^/]+)/execute", lambda m, b: self.in_session(m[2], m[1], sql(b), wait(b))),
            ("GET", "/config", lambda m, b: self.config.shown()),
            ("GET", "/metrics", lambda m, b: self.counts | {"sessions_open": len(self.sessions)}),
            ("GET", "/debug/catalog", lambda m, b: admin(lambda db: db.catalog_json())),
            ("GET", "/debug/storage", lambda m, b: admin(lambda db: db.storage_json())),
            ("POST", "/checkpoint", lambda m, b: admin(lambda db: db.checkpoint().to_json())),
            ("POST", "/execute", lambda m, b: self.execute(default, sql(b), wait(b))),
            ("POST", "/batch", lambda m, b: self.batch(statements(b), wait(b))),
            ("POST", "/session", lambda m, b: self.start(default)),
            ("DELETE", "/session/([^/]+)", lambda m, b: self.end(m[1], None)),
            ("POST", "/session/([^/]+)/execute", lambda m, b: self.in_session(m[1], None, sql(b), wait(b))),
        ]

    def call(self, method: str, path: str, body: dict, token: str | None) -> tuple[int, dict]:
        self.counts["requests"] += 1
        try:
            if self.config.token and path not in ("/health", "/version") and token != f"Bearer {self.config.token}":
                raise HttpError(401, "UNAUTHORIZED", "A bearer token is needed")
            for verb, pattern, action in self.routes():
                if verb == method and (m := re.fullmatch(pattern, path)):
                    return 200, action(m, body)
            raise HttpError(404, "NOT_FOUND", f"There is no {method} {path}")
        except HttpError as e:
            status, code, message = e.status, e.code, str(e)
        except DialectError as e:
            status, code, message = STATUS.get(e.code, 400), e.code, str(e)
        except Exception as e:  # Spark's own errors, such as overflow
            status, code, message = 400, "EXECUTION_ERROR", str(e).split("\n", 1)[0]
        self.counts["failed"] += 1
        return status, {"error": {"code": code, "message": message}}


def serve(service: Service) -> ThreadingHTTPServer:
    """A server bound to the configured address; the caller runs and closes it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                if not isinstance(body, dict):
                    raise ValueError
            except ValueError:
                status, out = 400, {"error": {"code": "INVALID_REQUEST", "message": "The body is no JSON object"}}
            else:
                status, out = service.call(self.command, unquote(self.path.split("?", 1)[0]), body, self.headers.get("Authorization"))
            data = json.dumps({"request_id": self.headers.get("X-Request-Id") or uuid.uuid4().hex} | out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((service.config.host, service.config.port), Handler)


def main(args: list[str] | None = None) -> None:
    config = Config.load(args)
    server = serve(Service(default_session("lodestone-server"), config))
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.server_close()


if __name__ == "__main__":
    main()
