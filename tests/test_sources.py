import json
import time

import pytest

from metawatch.sources import config, ingest, live


def groups(text):
    return ingest.normalise(ingest.parse(text))


def test_shapes_of_listings():
    assert groups('[{"name": "a"}]') == {"tool": [{"name": "a"}]}
    assert groups('{"name": "a"}') == {"tool": [{"name": "a"}]}
    assert groups('{"tools": null, "prompts": {"name": "p"}}') == {"tool": [], "prompt": [{"name": "p"}]}
    both = groups('{"tools": [{"name": "a"}], "result": {"tools": [{"name": "b"}], "resources": [{"uri": "r"}]}}')
    assert both == {"tool": [{"name": "a"}, {"name": "b"}], "resource": [{"uri": "r"}]}
    assert groups('{"instructions": "x", "serverInfo": {"name": "s"}}') == {"server": [{"instructions": "x", "serverInfo": {"name": "s"}}]}


@pytest.mark.parametrize("text", ["[1]", '{"tools": 3}', '{"jsonrpc": "2.0", "result": {}}', "{}", "3", "{", '{"instructions": 3}', 'data: {"result": 1}\n\ndata: {"result": 2}\n\n', "data: x\n\n"])
def test_errors(text):
    with pytest.raises(ingest.ListingError):
        groups(text)


def test_event_framing():
    assert ingest.event_data("data: a\r\ndata:b\r\r: c\ndata: d") == ["a\nb", "d"]
    assert groups('event: message\ndata: {"progress": 1}\n\ndata: {"result": {"tools": [{"name": "a"}]}}\n\n') == {"tool": [{"name": "a"}]}


def test_labels():
    assert ingest.entity_label({"name": " ", "uri": "u"}, "resource", 0) == "u"
    assert ingest.entity_label({"name": 3}, "tool", 4) == "<tool #4>"
    assert ingest.entity_label({"serverInfo": {"title": "t"}}, "server", 0) == "t"
    assert ingest.route_name({"name": " a "}, "tool") == " a " and ingest.route_name({"name": "a"}, "resource") is None


def test_jsonc():
    text = '{"a": "//x", // c\n "b": [1, 2,], /* d\n */ "c": "\\"/*",}'
    out = config.strip_jsonc(text)
    assert len(out) == len(text) and out.count("\n") == 2 and json.loads(out) == {"a": "//x", "b": [1, 2], "c": '"/*'}
    assert config.strip_jsonc("{,}") == "{,}" and config.strip_jsonc("[1,,]") == "[1,,]"
    with pytest.raises(config.ConfigError, match="line 2"):
        config.strip_jsonc("{\n/* x")
    t = time.process_time()
    config.strip_jsonc("/*" + "x\n" * 4000 + "*/" + json.dumps({str(i): {"command": "x"} for i in range(2000)}))
    assert time.process_time() - t < 2


def test_config():
    data = {
        "mcpServers": {"a": {"command": "run", "args": ["${env:X}", "${Y:-d}", "${not a name}"], "env": {"K": "${X}"}}, "b": {"url": "https://h.example/sse/"}, "c": {"command": "x", "url": "y"}},
        "servers": {"d": {"type": "Streamable-HTTP", "url": "u", "disabled": True, "headers": {"h": "${Z}"}}, "e": {"command": "${input:q}"}, "f": {"command": "${Z}"}, "g": 1},
        "inputs": [{"id": "q", "description": "the key"}, 3],
    }
    got = {s.name: s for s in config.parse_config(data, "/w/x", {"X": "1", "Y": ""})}
    assert got["a"].args == ["1", "d", "${not a name}"] and got["a"].env == {"K": "1"}
    assert (got["b"].transport, got["d"].transport, got["d"].headers) == ("sse", "http", {"h": "${Z}"})
    assert all(got[k].error for k in "cefg") and "the key" in got["e"].error
    assert [s.name for s in config.select(list(got.values()), ["d", "a"])] == ["a", "d"]
    for bad in ({}, [], {"servers": 3}, {"servers": {"a": {}}, "mcpServers": {"a": {}}}):
        with pytest.raises(config.ConfigError):
            config.parse_config(bad)
    with pytest.raises(config.ConfigError):
        config.select([], ["x"])


def test_server_specs(spark):
    rows = config.server_specs(spark, config.parse_config({"servers": {"a": {"command": "x"}, "b": {"url": "u"}}})).collect()
    assert [(r["name"], r["transport"]) for r in rows] == [("a", "stdio"), ("b", "http")]


def test_origins():
    assert live.stays_on_origin("http://h.example/a", "https://h.example/b") and live.stays_on_origin("https://h.example", "https://H.example:443/x")
    assert not live.stays_on_origin("https://h.example", "http://h.example") and not live.stays_on_origin("https://h.example", "https://i.example")
    assert live.headers_for("https://h.example", "https://i.example", {"a": "b"}) == {}
    assert live.public_url("https://u:p@h.example/a?b#c") == "https://h.example/a"
    assert live.cleartext("http://h.example") and not live.cleartext("http://127.0.0.1:3") and not live.cleartext("https://h.example")
    assert live.parse_headers(["a: b:c"]) == {"a": "b:c"} and live.redact("x longsecret short", ["longsecret", "short"]) == "x [redacted] short"
    for bad in ("ftp://x", "http://", "x"):
        with pytest.raises(ValueError):
            live.check_url(bad)


def test_live_servers(spark):
    def fetch(server, timeout):
        if server.name == "bad":
            raise RuntimeError("no hidden-token here")
        if server.name == "slow":
            time.sleep(3)
        return {"tool": [{"name": server.name}], "server": [{"instructions": "x"}]} if server.name != "none" else {}

    servers = [config.Server(n, "stdio", env={"T": "hidden-token"}) for n in ("ok", "bad", "slow", "none")] + [config.Server("off", disabled=True), config.Server("odd", error="why")]
    entities, status = live.read_live(spark, servers, fetch, 0.5)
    said = {r["name"]: (r["status"], r["error"]) for r in status.collect()}
    assert {k: v[0] for k, v in said.items()} == {"ok": "scanned", "bad": "failed", "slow": "failed", "none": "scanned", "off": "disabled", "odd": "failed"}
    assert "hidden-token" not in said["bad"][1] and "0.5 s" in said["slow"][1]
    assert sorted((r["source"], r["kind"]) for r in entities.collect()) == [("ok", "server"), ("ok", "tool")]


def test_collect_takes_what_a_session_offers():
    class Session:
        instructions, server_info = "hi", None
        list_tools = staticmethod(lambda: [{"name": "a"}])
        list_resources = staticmethod(lambda: [{"uri": "r"}])
        list_resource_templates = staticmethod(lambda: [{"uriTemplate": "t"}])

    assert live.collect(Session()) == {"tool": [{"name": "a"}], "server": [{"instructions": "hi"}], "prompt": [], "resource": [{"uri": "r"}, {"uriTemplate": "t"}]}


@pytest.mark.parametrize("call", ["list_prompts", "list_resources", "list_resource_templates"])
def test_a_surface_that_breaks_fails_the_server(call):
    class Refused(Exception):
        pass

    class Session:
        instructions, server_info = None, None
        list_tools = list_prompts = list_resources = list_resource_templates = staticmethod(lambda: [{"name": "a"}])

    def rows(error):
        def broken():
            raise error

        session = Session()
        setattr(session, call, broken)
        return live.fetched(config.Server("s", "stdio"), 0, lambda server, timeout: live.collect(session, Refused), 5)

    for error in (ConnectionResetError("dropped"), AttributeError("broken reply")):
        assert [(r[3], r[5]) for r in rows(error)] == [("failed", None)] and str(error) in rows(error)[0][4]
    assert {r[3] for r in rows(Refused())} == {"scanned"} and len(rows(Refused())) == 3
