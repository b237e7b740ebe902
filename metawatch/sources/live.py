"""Live servers as a Python data source: one partition per server, the fetcher injected.

A fetcher takes a Server and a time limit in seconds and gives groups of entities by kind.  What it
raises becomes that server's row of status "failed"; the others go on.  The network and child
processes belong to the fetcher, and so does cursor handling: listings are asked for once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Any
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.vocab import KINDS
from .config import Server
from .ingest import Groups, entity_label, route_name
from .store import once

Fetcher = Callable[[Server, float], Groups]

SCHEMA = "source string, source_ord int, transport string, status string, error string, kind string, kind_ord int, ord int, label string, route_name string, payload string"
_PORTS = {"http": 80, "https": 443}


class LiveError(RuntimeError):
    """Why a server was not read, in words for the report."""


def origin(url: str) -> tuple[str, str, int | None]:
    parts = urlsplit(url)
    scheme = parts.scheme.lower()
    return scheme, (parts.hostname or "").lower(), parts.port or _PORTS.get(scheme)


def shown_origin(url: str) -> str:
    """scheme://host, with the port where it is not the scheme's own."""
    scheme, host, port = origin(url)
    host = f"[{host}]" if ":" in host else host
    return f"{scheme}://{host}" + (f":{port}" if port not in (None, _PORTS.get(scheme)) else "")


def stays_on_origin(start: str, then: str) -> bool:
    """Whether credentials may go along: the same origin, or its plain port 80 raised to https on 443."""
    a, b = origin(start), origin(then)
    return a == b or (a[1] == b[1] and (a[0], a[2], b[0], b[2]) == ("http", 80, "https", 443))


def headers_for(start: str, then: str, headers: dict[str, str]) -> dict[str, str]:
    """The headers that a request to ``then`` may carry: none beyond the origin."""
    return dict(headers) if stays_on_origin(start, then) else {}


def public_url(url: str) -> str:
    """url without user, query and fragment."""
    p = urlsplit(url)
    return urlunsplit((p.scheme, p.netloc.rpartition("@")[2], p.path, "", ""))


def check_url(url: str) -> None:
    try:
        scheme, host, _ = origin(url)
    except ValueError as e:
        raise ValueError(f"not a URL: {e}") from None
    if scheme not in _PORTS or not host:
        raise ValueError("expected an http or https URL with a host")


def cleartext(url: str) -> bool:
    """Whether the URL sends in the clear beyond this machine."""
    scheme, host, _ = origin(url)
    return scheme == "http" and host != "localhost" and not host.startswith("127.") and host != "::1"


def parse_headers(lines: list[str]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError("a header is NAME: VALUE")
        out[name.strip()] = value.strip()
    return out


def redact(text: str, secrets: list[str]) -> str:
    """text without the secrets of eight characters or more, longest first."""
    for s in sorted({x for x in secrets if len(x) >= 8}, key=lambda x: (-len(x), x)):
        text = text.replace(s, "[redacted]")
    return text


def http_reason(status: int, hint: str = "/mcp") -> str:
    """What a status says; never with anything of the request."""
    if status in (401, 403):
        return f"HTTP {status}: the server wants other credentials, which --header or the config gives"
    return f"HTTP 404: nothing there; is the path right? Many end in {hint}" if status == 404 else f"HTTP {status}"


def collect(session: Any, protocol_error: type[Exception] | tuple[type[Exception], ...] = ()) -> Groups:
    """Groups from an opened session: handshake texts and tools, then prompts, resources and templates where there are any.

    protocol_error: what the session raises for a surface that the server refuses by the protocol.  All else, such as
    a dropped connection, is raised on and fails the server.
    """
    out: Groups = {"tool": list(session.list_tools())}
    server = {k: x for k, x in (("instructions", session.instructions), ("serverInfo", session.server_info)) if x}
    if server:
        out["server"] = [server]
    for kind, calls in (("prompt", ("list_prompts",)), ("resource", ("list_resources", "list_resource_templates"))):
        for call in calls:
            found = out.setdefault(kind, [])
            listing = getattr(session, call, None)
            if listing is None:  # a surface that a server does not offer is empty
                continue
            try:
                found += list(listing())
            except protocol_error:
                pass
    return out


def fetched(server: Server, ord_: int, fetch: Fetcher, timeout: float) -> list[tuple]:
    """Rows of one server: its entities, or one row that says why there are none."""
    empty = (None,) * 6
    if server.error or server.disabled:
        return [(server.name, ord_, server.transport, "failed" if server.error else "disabled", server.error, *empty)]
    pool = ThreadPoolExecutor(1)
    try:
        groups = pool.submit(fetch, server, timeout).result(timeout)
    except Late:
        return [(server.name, ord_, server.transport, "failed", f"no answer within {timeout:g} s", *empty)]
    except Exception as e:
        said = redact(str(e) if isinstance(e, LiveError) else f"{type(e).__name__}: {e}", [*server.env.values(), *server.headers.values(), *server.args])
        return [(server.name, ord_, server.transport, "failed", said, *empty)]
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    rows = [
        (server.name, ord_, server.transport, "scanned", None, kind, k, i, entity_label(x, kind, i), route_name(x, kind), json.dumps(x))
        for k, kind in enumerate(KINDS) for i, x in enumerate(groups.get(kind, []))
    ]
    return rows or [(server.name, ord_, server.transport, "scanned", None, *empty)]


def live_source(servers: list[Server], fetch: Fetcher, timeout: float = 20.0) -> type[DataSource]:
    """A data source class over these servers."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(i) for i in range(len(servers))]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from fetched(servers[partition.value], partition.value, fetch, timeout)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "live_servers"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source


def read_live(spark: SparkSession, servers: list[Server], fetch: Fetcher, timeout: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """(entities, source_status) of live servers, each asked once: what they say is written before anything is made of it."""
    spark.dataSource.register(live_source(servers, fetch, timeout))
    rows = once(spark.read.format("live_servers").load(), "live")
    status = rows.select("source", "source_ord", "transport", "status", "error").distinct().withColumnRenamed("source", "name")
    return rows.filter("kind is not null").drop("transport", "status", "error"), status
