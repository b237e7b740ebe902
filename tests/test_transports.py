"""Live servers over a child process and over a loopback listener."""

import json
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from queue import Queue

import pytest

from metawatch import cli
from metawatch.operators import state
from metawatch.sources import config, ingest, live, transports

RESULTS = {
    "initialize": {"capabilities": {"tools": {}, "resources": {}}, "instructions": "be kind", "serverInfo": {"name": "s"}},
    "tools/list": {"tools": [{"name": "a", "description": "adds"}]},
    "resources/list": {"resources": [{"uri": "u"}]},
}
WANT = {"tool": [{"name": "a", "description": "adds"}], "server": [{"instructions": "be kind", "serverInfo": {"name": "s"}}], "prompt": [], "resource": [{"uri": "u"}]}


def answer(message):
    if message["method"] in RESULTS:
        return {"jsonrpc": "2.0", "id": message["id"], "result": RESULTS[message["method"]]}
    return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": "unknown"}}


CHILD = f"""
import json, sys, time
results = {RESULTS!r}
for line in sys.stdin:
    m = json.loads(line)
    if "id" not in m or "method" not in m:
        continue
    print("noise", flush=True)
    print(json.dumps({{"jsonrpc": "2.0", "id": 99, "method": "ping"}}), flush=True)
    r = results.get(m["method"])
    print(json.dumps({{"jsonrpc": "2.0", "id": m["id"], **({{"result": r}} if r else {{"error": {{"message": "unknown"}}}})}}), flush=True)
"""


def child(code, **more):
    return config.Server("c", "stdio", sys.executable, ["-c", code], **more)


def test_a_process_is_listed():
    assert transports.fetch(child(CHILD), 20) == WANT


def test_processes_that_fail():
    for server, said in (
        (child("pass"), "without an answer|went away"),
        (config.Server("c", "stdio", "/no/such/command"), "cannot be launched"),
        (child("import time; time.sleep(60)"), "no answer within 0.5 s"),
        (child("import sys, json\nfor l in sys.stdin: print(json.dumps({'id': json.loads(l).get('id'), 'error': {'message': 'closed'}}), flush=True)"), "refuses: closed"),
    ):
        begin = time.monotonic()
        with pytest.raises(live.LiveError, match=said):
            transports.fetch(server, 0.5 if "sleep" in str(server.args) else 20)
        assert time.monotonic() - begin < 10


def test_a_process_gets_its_settings_and_little_else(monkeypatch, tmp_path):
    monkeypatch.setenv("OUR_SECRET", "x")
    told = "import os; RESULTS['tools/list'] = {'tools': [{'name': os.getcwd(), 'description': os.environ['K'] + str('OUR_SECRET' in os.environ)}]}"
    code = CHILD.replace("for line", told.replace("RESULTS", "results") + "\nfor line")
    assert transports.fetch(child(code, env={"K": "v"}, cwd=str(tmp_path)), 20)["tool"] == [{"name": str(tmp_path), "description": "vFalse"}]


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def _send(self, code, body=b"", kind="application/json", **headers):
        self.send_response(code)
        for k, v in {"Content-Type": kind, "Content-Length": str(len(body)), **headers}.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        self.server.seen.append((self.path, self.headers.get("X-Key"), self.headers.get("Mcp-Session-Id")))
        message = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.startswith("/status"):
            return self._send(int(self.path[-3:]))
        if self.path == "/away":
            return self._send(307, Location=self.server.other)
        if self.path == "/near":
            return self._send(307, Location="/json")
        if self.path == "/loop":
            return self._send(307, Location="/loop")
        if "id" not in message:
            return self._send(202)
        reply = json.dumps(answer(message))
        if self.path == "/messages":
            self.server.stream.put(reply)
            return self._send(202)
        if self.path == "/events":
            ping = json.dumps({"jsonrpc": "2.0", "method": "notifications/progress"})
            return self._send(200, f": hello\nevent: message\ndata: {ping}\n\ndata: {reply}\r\n\r\n".encode(), "text/event-stream", Mcp_Session_Id="id1")
        self._send(200, reply.encode())

    def do_DELETE(self):
        self.server.seen.append(("DELETE", self.headers.get("X-Key"), self.headers.get("Mcp-Session-Id")))
        self._send(405)

    def do_GET(self):
        self.send_response(200)
        self.send_header("Content-Type", "text/event-stream")
        self.end_headers()
        place = self.server.other + "x" if self.path == "/elsewhere/sse" else "/messages"
        self.wfile.write(f"event: endpoint\ndata: {place}\n\n".encode())
        self.wfile.flush()
        while (reply := self.server.stream.get()) is not None:
            try:
                self.wfile.write(f"event: message\ndata: {reply}\n\n".encode())
                self.wfile.flush()
            except OSError:
                return


@pytest.fixture
def web():
    servers = [ThreadingHTTPServer(("127.0.0.1", 0), Handler) for _ in range(2)]
    for s, t in zip(servers, reversed(servers)):
        s.seen, s.stream, s.other, s.daemon_threads = [], Queue(), f"http://127.0.0.1:{t.server_port}/json", True
        s.at = f"http://127.0.0.1:{s.server_port}"
        threading.Thread(target=s.serve_forever, daemon=True).start()
    yield servers
    for s in servers:
        s.stream.put(None)
        s.shutdown()
        s.server_close()


def asked(kind, url, **headers):
    return transports.fetch(config.Server("h", kind, url=url, headers={k.replace("_", "-"): v for k, v in headers.items()}), 10)


def test_http_is_listed(web):
    for path in ("/json", "/events", "/near"):
        assert asked("http", web[0].at + path, X_Key="k1") == WANT
    assert {key for _, key, _ in web[0].seen} == {"k1"}
    assert ("DELETE", "k1", "id1") in web[0].seen and ("/events", "k1", "id1") in web[0].seen


def test_sse_is_listed(web):
    assert asked("sse", web[0].at + "/sse", X_Key="k1") == WANT
    assert {x[:2] for x in web[0].seen} == {("/messages", "k1")}


def test_headers_stay_on_their_origin(web):
    with pytest.raises(live.LiveError, match=f"another origin, {web[1].at}"):
        asked("http", web[0].at + "/away", X_Key="k1")
    assert {key for _, key, _ in web[1].seen} == {None}
    assert asked("http", web[0].at + "/away") == WANT  # nothing to keep, so the redirect is followed
    for headers in ({}, {"X_Key": "k1"}):
        with pytest.raises(live.LiveError, match="another origin"):
            asked("sse", web[0].at + "/elsewhere/sse", **headers)


def test_statuses_say_what_to_do(web):
    for path, said in (("/status401", "--header"), ("/status404", "/mcp"), ("/status500", "HTTP 500"), ("/loop", "redirects")):
        with pytest.raises(live.LiveError, match=said):
            asked("http", web[0].at + path, X_Key="k1")
    web[1].shutdown()
    web[1].server_close()
    with pytest.raises(live.LiveError, match="no connection"):
        asked("http", web[1].at + "/json")
    threading.Thread(target=web[1].serve_forever, daemon=True)


def run(spark, *argv, fetch=None):
    out, err = [], []
    return cli.main(list(argv), spark, fetch, out.append, err.append), "\n".join(out), "\n".join(err)


def test_the_command_line_asks_each_server_once(spark, web, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"mcpServers": {"one": {"url": web[0].at + "/json"}}}))
    pin = str(tmp_path / "pin.json")
    assert run(spark, "--http", web[0].at + "/json", "--write-pin", pin)[0] == 0
    assert all("source" not in e for e in json.load(open(pin))["entities"])
    web[0].seen.clear()
    code, out, err = run(spark, "--config", str(path), "--pin", pin, "--no-color")  # a pin without a server, taken over by the only one
    assert (code, err) == (0, "") and "be kind" not in err and "1 of 1 server(s)" in out
    assert len(web[0].seen) == 5  # handshake, its notice, and three listings


def test_scope(spark):
    def pins(*names):
        return spark.createDataFrame([(n, "tool", "a", 1, {"x": "y"}) for n in names], "source string, kind string, label string, occ int, fields map<string,string>")

    def scanned(*names):
        return spark.createDataFrame([(n,) for n in names], "source string")

    def got(pinned, seen):
        kept, left = state.scope(pinned, seen)
        return sorted(r["source"] or "-" for r in kept.collect()), sorted(r["source"] or "-" for r in left.collect())

    assert got(pins(), scanned("a")) == ([], [])
    assert got(pins("a", "a"), None) == (["-", "-"], [])
    assert got(pins(None), scanned("b")) == (["b"], [])
    assert got(pins("a", "b", None), scanned("b", "c")) == (["b"], ["-", "a"])
    for pinned, seen in ((pins("a", "b"), None), (pins(None), scanned("a", "b")), (pins("a"), scanned("b"))):
        with pytest.raises(state.ScopeError):
            state.scope(pinned, seen)


def test_state_order(spark):
    rows = [(None, "zebra", "a", 1), (None, "server", "a", 1), (None, "apple", "b", 1), (None, "prompt", "a", 2), (None, "prompt", "a", 1), ("s", "tool", "a", 1), (None, "tool", "z", 1)]
    got = spark.createDataFrame(rows, "source string, kind string, label string, occ int").orderBy(*state.state_order()).collect()
    assert [(r["kind"], r["occ"]) for r in got] == [("tool", 1), ("prompt", 1), ("prompt", 2), ("server", 1), ("apple", 1), ("zebra", 1), ("tool", 1)]


def test_documents_are_read_by_one_scan(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("b b.json", "a.json")]
    for p in paths:
        open(p, "w").write(json.dumps([{"name": p[-6:]}]))
    rows = ingest.read_documents(spark, paths).orderBy("source_ord").collect()
    assert [r["source"] for r in rows] == paths and rows[1]["content"] == '[{"name": "a.json"}]'
