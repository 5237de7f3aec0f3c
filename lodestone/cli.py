"""Command line: `execute SQL`, bare SQL, or `shell`, on a database directory or a server."""

from __future__ import annotations

import argparse
import json
import sys
from urllib import error, request

from .errors import DialectError
from .plans.parser import parse
from .session import Database, default_session

HELP = """help              this text
parse <command>   the parsed statement
exit, quit        leave
anything else     a statement"""


class Remote:
    """A session on a server."""

    def __init__(self, url: str, token: str | None = None):
        self.url, self.token = url.rstrip("/"), token
        self.session = self._post("/session", {})["session_id"]

    def _post(self, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with request.urlopen(request.Request(self.url + path, json.dumps(body).encode(), headers)) as r:
                return json.load(r)
        except error.HTTPError as e:
            raise DialectError(json.load(e)["error"]["message"]) from None
        except OSError as e:
            raise DialectError(f"The server can't be reached: {e}") from None

    def text(self, sql: str) -> str:
        out = self._post(f"/session/{self.session}/execute", {"sql": sql})
        if out["type"] != "select":
            return out["message"]
        lines = ["\t".join(c["name"] for c in out["schema"])]
        for row in out["rows"]:
            lines.append("\t".join("null" if v is None else v if isinstance(v, str) else json.dumps(v) for v in row))
        return "\n".join(lines)


class Local:
    def __init__(self, path: str):
        spark = default_session("lodestone-cli", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
        spark.sparkContext.setLogLevel("ERROR")
        self.database = Database(spark, path)

    def text(self, sql: str) -> str:
        return self.database.execute(sql).text()


def shell(target, lines=None, out=print) -> None:
    for line in lines if lines is not None else iter(lambda: input("db> "), None):
        line = line.strip()
        word, _, rest = line.partition(" ")
        try:
            if not line:
                continue
            if word.lower() in ("exit", "quit") and not rest:
                return
            if word.lower() == "help" and not rest:
                out(HELP)
            elif word.lower() == "parse":
                out(repr(parse(rest)))
            else:
                out(target.text(line))
        except Exception as e:  # the shell goes on after any error
            out(f"Error: {str(e).splitlines()[0]}")


def main(args: list[str] | None = None, out=print) -> int:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--db-path", default="./lodestone-db")
    p.add_argument("--remote", help="address of a server")
    p.add_argument("--token")
    p.add_argument("words", nargs="*", help="shell, execute SQL, or SQL")
    a = p.parse_args(args)
    try:
        target = Remote(a.remote, a.token) if a.remote else Local(a.db_path)
        if not a.words or a.words == ["shell"]:
            shell(target)
            return 0
        words = a.words[1:] if a.words[0] == "execute" else a.words
        out(target.text(" ".join(words)))
        return 0
    except EOFError:
        return 0
    except Exception as e:
        out(f"Error: {str(e).splitlines()[0]}")
        return 1


if __name__ == "__main__":
    sys.exit(main())
