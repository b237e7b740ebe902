"""Client configurations: JSON with comments, to one row per server."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from os import environ
from pathlib import Path
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..functions.render import visible


Strings = dict[str, str]


class ConfigError(ValueError):
    """A configuration that cannot be read as a whole."""


@dataclass(frozen=True)
class Server:
    """One entry: with an error, switched off, or ready to be asked."""

    name: str
    transport: str | None = None
    command: str | None = None
    args: list[str] = field(default_factory=list)
    env: Strings = field(default_factory=dict)
    cwd: str | None = None
    url: str | None = None
    headers: Strings = field(default_factory=dict)
    disabled: bool = False
    error: str | None = None


SCHEMA = "ord int, name string, transport string, command string, args array<string>, env map<string,string>, cwd string, url string, headers map<string,string>, disabled boolean, error string"

_HOLE = re.compile("[$][{]([^}{]*)[}]")
_STRING = r'"(?:\\.|[^"\\])*(?:"|\\?$)'
_COMMENTS = re.compile(rf"{_STRING}|//[^\n]*|/\*.*?\*/|/\*", re.S)
_MARKS = re.compile(rf"{_STRING}|[^\t\n\r ]", re.S)


def _blanks(text: str) -> str:
    return re.sub(r"[^\r\n]", " ", text)


def strip_comments(text: str) -> str:
    """text with comments blanked out, as long as before and with its line breaks."""

    def one(m: re.Match[str]) -> str:
        if m[0] == "/*":
            raise ConfigError(f"block comment opened on line {text.count(chr(10), 0, m.start()) + 1} is never closed")
        return m[0] if m[0].startswith('"') else _blanks(m[0])

    return _COMMENTS.sub(one, text)


def strip_trailing_commas(text: str) -> str:
    """text with each comma blanked that stands between a value and a closing bracket."""
    out, before, comma = list(text), "", None
    for m in _MARKS.finditer(text):
        mark = m[0][0]
        if mark in "]}" and comma is not None:
            out[comma] = " "
        comma = m.start() if mark == "," and before not in ("", "[", "{", ",") else None
        before = mark
    return "".join(out)


def strip_jsonc(text: str) -> str:
    return strip_trailing_commas(strip_comments(text))


@dataclass(frozen=True)
class Values:
    """What placeholders stand for; on=False leaves them as written."""

    env: Mapping[str, str]
    folder: str | None = None
    inputs: Strings = field(default_factory=dict)
    on: bool = True

    def expand(self, text: str, where: str) -> str:
        """text with its placeholders filled in, once: what comes in is not looked at again."""
        return _HOLE.sub(lambda m: self._one(m[1], where), text) if self.on else text

    def _one(self, ref: str, where: str) -> str:
        shown = f"${{{visible(ref)}}}"
        name, has_default, default = ref.partition(":-")
        if name == "userHome":
            return str(Path.home())
        if name.startswith("workspaceFolder") and name.removeprefix("workspaceFolder") in ("", "Basename"):
            if self.folder is None:
                raise ConfigError(f"{where} references {shown}, but the config did not come from a file")
            return Path(self.folder).name if name.endswith("Basename") else self.folder
        if name.startswith("input:"):
            said = self.inputs.get(name.removeprefix("input:"))
            raise ConfigError(f"{where} needs {shown}{f' ({visible(said)})' if said else ''}, which only a prompt can supply")
        if name.startswith("command:"):
            raise ConfigError(f"{where} needs {shown}, which only its editor can run")
        plain = name.removeprefix("env:")
        if not plain or (plain == name and not re.fullmatch("[A-Za-z_][0-9A-Za-z_]*", plain)):
            return f"${{{ref}}}"
        value = self.env.get(plain)
        if value or (value is not None and not has_default):
            return value
        if has_default:
            return default
        raise ConfigError(f"{where} references {shown}, which is not set here")


def transport_of(url: str) -> str:
    """sse for a path that ends in /sse, http for others."""
    return "sse" if urlsplit(url).path.rstrip("/").endswith("/sse") else "http"


_KNOWN = {k: k for k in ("sse", "stdio", "http")} | dict.fromkeys(("streamable_http", "streamablehttp", "streamable-http"), "http")


def _strings(entry: dict, key: str, kind: type) -> Any:
    value = entry.get(key)
    if value is None:
        return kind()
    flat = list(value.values()) + list(value) if isinstance(value, dict) else value
    if not isinstance(value, kind) or not all(isinstance(x, str) for x in flat):
        raise ConfigError(f'"{key}" must be {"a list of strings" if kind is list else "an object of strings"}')
    return value


def _server(name: str, entry: Any, values: Values) -> Server:
    if not isinstance(entry, dict):
        raise ConfigError("an entry must be an object")
    off = entry.get("disabled") is True
    if off:
        values = Values({}, on=False)
    declared = entry["type"] if "type" in entry else entry.get("transport")
    command, url = entry.get("command"), entry.get("url")
    if declared is not None and not isinstance(declared, str):
        raise ConfigError('"type" must be a string')
    transport = _KNOWN.get(declared.strip().lower()) if declared is not None else None
    if declared is not None and transport is None:
        raise ConfigError(f"unknown transport '{visible(declared)}'")
    if command is not None and url is not None:
        raise ConfigError('has a "command" and a "url"')
    if isinstance(url, str):
        url = values.expand(url, '"url"')
    if not transport:
        if command is None and url is None:
            raise ConfigError('has neither a "command" nor a "url"')
        transport = "stdio" if command is not None else transport_of(str(url))

    def filled(key: str) -> dict[str, str]:
        return {k: values.expand(x, f"\"{key}\" value for '{visible(k)}'") for k, x in _strings(entry, key, dict).items()}

    needed = "command" if transport == "stdio" else "url"
    value = command if transport == "stdio" else url
    if value is None:
        raise ConfigError(f'type "{transport}" needs a "{needed}"')
    if transport == "stdio" and isinstance(value, str):
        value = values.expand(value, '"command"')
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f'"{needed}" must be a non-empty string')
    if transport != "stdio":
        return Server(name, transport, url=value, headers=filled("headers"), disabled=off)
    if not isinstance(cwd := entry.get("cwd"), str | None):
        raise ConfigError('"cwd" must be a string')
    args = [values.expand(x, f'"args[{i}]"') for (i, x) in enumerate(_strings(entry, "args", list))]
    return Server(name, transport, value, args, filled("env"), None if cwd is None else values.expand(cwd, '"cwd"'), disabled=off)


def parse_config(data: Any, folder: str | None = None, env: Mapping[str, str] | None = None) -> list[Server]:
    """Servers in file order; what is wrong with one is its own error."""
    blocks = [(k, data[k]) for k in ("mcpServers", "servers") if data.get(k) is not None] if isinstance(data, dict) else []
    if not blocks:
        raise ConfigError('a config is an object with an "mcpServers" or "servers" map')
    inputs = data.get("inputs")
    said = {x["id"]: x["description"] if isinstance(x.get("description"), str) else "" for x in inputs if isinstance(x, dict) and isinstance(x.get("id"), str)} if isinstance(inputs, list) else {}
    values, out = Values(environ if env is None else env, folder, said), {}
    for key, block in blocks:
        if not isinstance(block, dict):
            raise ConfigError(f'"{key}" must be an object of servers')
        for name, entry in block.items():
            if name in out:
                raise ConfigError(f"server '{visible(name)}' is defined twice")
            try:
                out[name] = _server(name, entry, values)
            except ConfigError as e:
                out[name] = Server(name, error=str(e))
    return list(out.values())


def load_config(path: str, env: Mapping[str, str] | None = None) -> list[Server]:
    """A config file's servers; its folder, or the one above .vscode, is the workspace."""
    text = strip_jsonc(Path(path).read_text("utf-8"))
    folder = Path(path).absolute().parent
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"not JSON, even without comments and trailing commas: {e}") from None
    return parse_config(data, str(folder.parent if folder.name == ".vscode" else folder), env)


def select(servers: list[Server], names: list[str]) -> list[Server]:
    """The named servers in config order (all, without names)."""
    missing = [n for n in names if n not in {s.name for s in servers}]
    if missing:
        raise ConfigError("the config has no server " + ", ".join(f"'{visible(n)}'" for n in missing))
    return [s for s in servers if not names or s.name in names]


def server_specs(spark: SparkSession, servers: list[Server]) -> DataFrame:
    """Servers as a table; ord is the file order."""
    return spark.createDataFrame([(i, *asdict(s).values()) for i, s in enumerate(servers)], SCHEMA)
