"""Fetchers of live servers: a child process, HTTP, and HTTP with an event stream; standard library only.

All three open the same session: handshake, then the listings, nothing else is ever called.  Headers
belong to the origin of the URL they were given for; a server that leads elsewhere fails as a whole.
"""

from __future__ import annotations

import json
import os
import subprocess
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import IO, Any
from urllib.parse import urljoin

from .config import Server
from .ingest import Groups
from .live import LiveError, collect, headers_for, http_reason, origin, shown_origin, stays_on_origin

VERSION = "2025-06-18"
_INHERITED = ("HOME", "LOGNAME", "PATH", "SHELL", "TERM", "USER")
_HOPS = 20
_METHODS = {"tools": ("list_tools", "tools/list"), "prompts": ("list_prompts", "prompts/list"), "resources": ("list_resources", "resources/list")}
_TEMPLATES = ("list_resource_templates", "resources/templates/list", "resourceTemplates")


class RefusedError(Exception):
    """An error reply of the protocol."""


class Clock:
    """Seconds left of a server's time."""

    def __init__(self, timeout: float):
        self.end = time.monotonic() + timeout

    def left(self) -> float:
        rest = self.end - time.monotonic()
        if rest <= 0:
            raise TimeoutError("out of time")
        return rest


class Session:
    """An opened session, as ``collect`` asks it: a surface that is not offered has no method."""

    def __init__(self, call: Callable[[dict], dict | None]):
        self._call, self._n = call, 0
        hello = self._ask("initialize", {"protocolVersion": VERSION, "capabilities": {}, "clientInfo": {"name": "metawatch", "version": "0.1.0"}})
        call({"jsonrpc": "2.0", "method": "notifications/initialized"})
        said, offers = hello.get("instructions"), hello.get("capabilities")
        self.instructions = said if isinstance(said, str) else None
        self.server_info = hello.get("serverInfo")
        for surface, (name, method) in _METHODS.items():
            if surface == "tools" or (isinstance(offers, dict) and offers.get(surface) is not None):
                setattr(self, name, lambda m=method, k=surface: self._listed(m, k))
                if surface == "resources":
                    setattr(self, _TEMPLATES[0], lambda: self._listed(*_TEMPLATES[1:]))

    def _ask(self, method: str, params: dict) -> dict:
        self._n += 1
        reply = self._call({"jsonrpc": "2.0", "id": self._n, "method": method, "params": params})
        if reply is None:
            raise LiveError(f"the server ended without an answer to {method}")
        if reply.get("error") is not None:
            error = reply["error"]
            raise RefusedError(str(error.get("message", error)) if isinstance(error, dict) else str(error))
        if not isinstance(reply.get("result"), dict):
            raise LiveError(f"the answer to {method} has no result")
        return reply["result"]

    def _listed(self, method: str, key: str) -> list[dict]:
        found = self._ask(method, {}).get(key)
        if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
            raise LiveError(f"the answer to {method} has no list of objects")
        return found


def _message(text: str | bytes) -> dict | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _answered(messages: Iterator[dict | None], wanted: Any, reply: Callable[[dict], Any]) -> dict | None:
    """The first message that answers the wanted id; the server's own requests on the way are turned down."""
    for m in messages:
        if m is None:
            continue
        if "method" in m:
            if "id" in m:
                said = {"result": {}} if m["method"] == "ping" else {"error": {"code": -32601, "message": "not offered"}}
                reply({"jsonrpc": "2.0", "id": m["id"], **said})
        elif m.get("id") == wanted:
            return m
    return None


def from_process(server: Server, timeout: float) -> Groups:
    """Listings of a server that is launched; it is killed when its time is over, and stopped after the listings."""
    clock = Clock(timeout)
    env = {k: os.environ[k] for k in _INHERITED if k in os.environ} | server.env
    try:
        child = subprocess.Popen([server.command or "", *server.args], env=env, cwd=server.cwd, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    except OSError as e:
        raise LiveError(f"cannot be launched: {e.strerror or e}") from None
    late = threading.Timer(timeout, child.kill)
    late.daemon = True
    late.start()

    def send(message: dict) -> None:
        child.stdin.write(json.dumps(message).encode() + b"\n")
        child.stdin.flush()

    def call(message: dict) -> dict | None:
        send(message)
        return _answered((_message(line) for line in iter(child.stdout.readline, b"")), message["id"], send) if "id" in message else None

    try:
        return collect(Session(call), RefusedError)
    except OSError as e:
        clock.left()
        raise LiveError(f"the process went away: {e.strerror or e}") from None
    except LiveError:
        clock.left()  # a killed child ends its output
        raise
    finally:
        late.cancel()
        for end in (child.stdin, child.stdout):
            try:
                end.close()
            except OSError:
                pass
        child.terminate()
        try:
            child.wait(2)
        except subprocess.TimeoutExpired:
            child.kill()
            child.wait()


class Lock:
    """Keeps the headers of a scan on the origin of its URL, and knows where else it was led first."""

    def __init__(self, url: str, headers: dict[str, str]):
        self.url, self.headers, self.led_to = url, headers, None

    def allowed(self, url: str) -> dict[str, str]:
        if self.headers and self.led_to is None and not stays_on_origin(self.url, url):
            self.led_to = shown_origin(url)
        return headers_for(self.url, url, self.headers)

    def check(self) -> None:
        if self.led_to is not None:
            raise LiveError(f"the endpoint leads to another origin, {self.led_to}; no header went there, and its answers are not taken")


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: Any) -> None:
        return None


def _request(method: str, url: str, body: dict | None, fixed: dict[str, str], lock: Lock, clock: Clock) -> IO[bytes]:
    """The response, after redirects; what is sent on the way is up to the lock."""
    opener = urllib.request.build_opener(_Stay)
    data = None if body is None else json.dumps(body).encode()
    for _ in range(_HOPS):
        asked = urllib.request.Request(url, data, {**lock.allowed(url), **fixed}, method=method)
        try:
            return opener.open(asked, timeout=clock.left())
        except urllib.error.HTTPError as e:
            to = e.headers.get("Location")
            if e.code not in (301, 302, 303, 307, 308) or not to:
                raise
            e.close()
            url = urljoin(url, to)
            if origin(url)[0] not in ("http", "https"):
                raise LiveError("redirected to what is no http or https URL") from None
            if e.code == 303 or (e.code in (301, 302) and method == "POST"):
                method, data = "GET", None
    raise LiveError(f"more than {_HOPS} redirects")


def _events(stream: IO[bytes], clock: Clock) -> Iterator[tuple[str, str]]:
    """(event, data) of an event stream as it comes in."""
    event, lines = "message", []
    for raw in iter(stream.readline, b""):
        clock.left()
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not line:
            if lines:
                yield event, "\n".join(lines)
            event, lines = "message", []
            continue
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "event":
            event = value
        elif name == "data":
            lines.append(value)


def _guarded(run: Callable[[], Groups], lock: Lock, hint: str) -> Groups:
    """What run gives; that headers were led off their origin outranks it, be it listings or a failure."""
    try:
        found = run()
    except urllib.error.HTTPError as e:
        lock.check()
        raise LiveError(http_reason(e.code, hint)) from None
    except TimeoutError:
        lock.check()
        raise
    except (urllib.error.URLError, OSError) as e:
        lock.check()
        cause = getattr(e, "reason", e)
        if isinstance(cause, TimeoutError):
            raise cause from None
        raise LiveError(f"no connection: {type(cause).__name__}") from None
    except Exception:
        lock.check()
        raise
    lock.check()
    return found


def from_http(server: Server, timeout: float) -> Groups:
    """Listings over plain requests, each answered by JSON or by an event stream."""
    clock, lock, extra = Clock(timeout), Lock(server.url or "", server.headers), {}

    def call(message: dict) -> dict | None:
        fixed = {"Content-Type": "application/json", "Accept": "application/json, text/event-stream", **extra}
        with _request("POST", server.url or "", message, fixed, lock, clock) as r:
            if known := r.headers.get("Mcp-Session-Id"):
                extra["Mcp-Session-Id"] = known
            extra["MCP-Protocol-Version"] = VERSION
            if "id" not in message or "method" not in message:
                return None
            if r.headers.get_content_type() == "text/event-stream":
                return _answered((_message(d) for _, d in _events(r, clock)), message["id"], call)
            return _answered(iter([_message(r.read())]), message["id"], call)

    def run() -> Groups:
        try:
            return collect(Session(call), RefusedError)
        finally:
            if "Mcp-Session-Id" in extra and lock.led_to is None:
                try:
                    _request("DELETE", server.url or "", None, dict(extra), lock, clock).close()
                except (OSError, LiveError):  # a server need not end sessions
                    pass

    return _guarded(run, lock, "/mcp")


def from_events(server: Server, timeout: float) -> Groups:
    """Listings over the older transport: answers come in one stream, requests go to the endpoint that it names first."""
    clock, lock = Clock(timeout), Lock(server.url or "", server.headers)

    def run() -> Groups:
        with _request("GET", server.url or "", None, {"Accept": "text/event-stream"}, lock, clock) as stream:
            events = _events(stream, clock)
            start = next((d for e, d in events if e == "endpoint"), None)
            if start is None:
                raise LiveError("the stream names no endpoint")
            endpoint = urljoin(stream.geturl(), start.strip())
            if not stays_on_origin(stream.geturl(), endpoint):
                lock.allowed(endpoint)
                raise LiveError("the stream names an endpoint of another origin")

            def send(message: dict) -> None:
                _request("POST", endpoint, message, {"Content-Type": "application/json"}, lock, clock).close()

            def call(message: dict) -> dict | None:
                send(message)
                return _answered((_message(d) for e, d in events if e == "message"), message["id"], send) if "id" in message else None

            return collect(Session(call), RefusedError)

    return _guarded(run, lock, "/sse")


_BY = {"stdio": from_process, "http": from_http, "sse": from_events}


def fetch(server: Server, timeout: float) -> Groups:
    """Listings of a server by its transport."""
    try:
        return _BY[server.transport or ""](server, timeout)
    except RefusedError as e:
        raise LiveError(f"the server refuses: {e}") from None
    except TimeoutError:
        raise LiveError(f"no answer within {timeout:g} s; --timeout gives it longer") from None
