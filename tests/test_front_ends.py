import json
import threading
from urllib import error, request

import pytest

from lodestone import cli
from lodestone.server import Config, Service, serve


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    return Service(spark, Config(data_dir=str(tmp_path_factory.mktemp("data")), port=0, token="s3"))


def call(service, method, path, body=None, token="Bearer s3"):
    return service.call(method, path, body or {}, token)


def test_routes(service):
    assert call(service, "GET", "/health", token=None) == (200, {"status": "ok"})
    assert call(service, "GET", "/databases", token=None)[0] == 401
    assert call(service, "GET", "/config")[1]["token"] == "set" and call(service, "GET", "/version")[1]["api"] == "v1"
    assert call(service, "POST", "/databases", {"name": "d1"})[0] == 200
    assert call(service, "POST", "/databases", {"name": "d1"})[1]["error"]["code"] == "DATABASE_ALREADY_EXISTS"
    assert call(service, "POST", "/databases", {"name": "../x"})[1]["error"]["code"] == "INVALID_DATABASE_NAME"
    assert call(service, "POST", "/databases/d1/execute", {"sql": "create table t (id int primary key, v json)"})[0] == 200
    assert call(service, "POST", "/databases/d1/execute", {"sql": 'insert into t values (1, "[1]")'})[1]["stats"] == {"rows_affected": 1}
    assert call(service, "POST", "/databases/d1/execute", {"sql": "select * from t"})[1]["rows"] == [[1, [1]]]
    package = call(service, "GET", "/databases/d1/export")[1]
    assert call(service, "POST", "/databases/d2/import", {"package": package})[0] == 200
    assert call(service, "POST", "/databases/d2/import", {"package": package})[0] == 409
    assert call(service, "POST", "/databases/d2/execute", {"sql": "select id from t"})[1]["rows"] == [[1]]
    assert call(service, "GET", "/databases")[1]["databases"] == ["d1", "d2", "default"]
    assert call(service, "DELETE", "/databases/default")[1]["error"]["code"] == "DATABASE_DELETE_DENIED"
    assert call(service, "DELETE", "/databases/d2")[0] == 200 and call(service, "GET", "/databases/d2/export")[0] == 404


def test_sessions_batch_and_errors(service):
    out = call(service, "POST", "/batch", {"statements": ["create table b (id int unique)", "insert into b values (1)", "insert into b values (1)", "insert into b values (2)"]})[1]
    assert out["failed_at"] == 2 and out["error"]["code"] == "UNIQUE_VIOLATION" and len(out["results"]) == 2
    assert call(service, "POST", "/execute", {"sql": "begin"})[1]["error"]["code"] == "TRANSACTION_REQUIRES_SESSION"
    assert call(service, "POST", "/execute", {"sql": "selec"})[1]["error"]["code"] == "UNSUPPORTED_SYNTAX"
    assert call(service, "POST", "/execute", {"sql": "select * from zz"}) [0] == 404
    assert call(service, "POST", "/execute", {})[1]["error"]["code"] == "INVALID_REQUEST"
    key = call(service, "POST", "/session")[1]["session_id"]
    run = lambda sql: call(service, "POST", f"/session/{key}/execute", {"sql": sql})
    run("begin")
    run("insert into b values (5)")
    assert call(service, "DELETE", f"/session/{key}")[1]["error"]["code"] == "SESSION_HAS_ACTIVE_TRANSACTION"
    assert run("commit")[0] == 200 and call(service, "DELETE", f"/session/{key}")[0] == 200
    assert call(service, "POST", "/execute", {"sql": "select id from b order by id"})[1]["rows"] == [[1], [5]]
    assert call(service, "DELETE", f"/session/{key}")[0] == 404 and call(service, "GET", "/nope")[0] == 404
    assert call(service, "GET", "/metrics")[1]["transactions_committed"] == 1
    assert "b" in call(service, "GET", "/debug/catalog")[1] and call(service, "GET", "/debug/storage")[1]["b"]["rows"] == 2
    assert call(service, "POST", "/checkpoint")[0] == 200


def test_over_http_and_remote_cli(service):
    server = serve(service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert json.load(request.urlopen(url + "/health"))["status"] == "ok"
        with pytest.raises(error.HTTPError) as bad:
            request.urlopen(request.Request(url + "/execute", b"[", {"Authorization": "Bearer s3"}))
        assert bad.value.code == 400
        said = []
        assert cli.main(["--remote", url, "--token", "s3", "execute", "create table remote (id int, v text)"], said.append) == 0
        assert cli.main(["--remote", url, "--token", "s3", "select * from remote"], said.append) == 0
        assert cli.main(["--remote", url, "--token", "s3", "select * from"], said.append) == 1
        assert said[0] == "created table remote" and said[1] == "id\tv" and said[2].startswith("Error: ")
        assert cli.main(["--remote", "http://127.0.0.1:9", "select 1"], said.append) == 1
    finally:
        server.shutdown()
        server.server_close()


def test_shell(db):
    class Local:
        def text(self, sql):
            return db.execute(sql).text()

    said = []
    cli.shell(Local(), ["help", "parse select * from t", "create table t (id int)", "", "nonsense", "quit", "never"], said.append)
    assert said[0] == cli.HELP and said[1].startswith("Select(") and said[2] == "created table t" and said[3].startswith("Error: ") and len(said) == 4


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps({"port": 1, "database": "f", "host": "h"}))
    monkeypatch.setenv("LODESTONE_DATABASE", "e")
    c = Config.load(["--config", str(tmp_path / "c.json"), "--host", "a"])
    assert (c.port, c.database, c.host) == (1, "e", "a")
