"""Reports from collected rows: text, JSON, SARIF, notices, and the two state files."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.render import visible
from ..functions.vocab import KINDS
from ..operators import state

NAME = "metawatch"
BANDS = tuple("CLEAN LOW MEDIUM HIGH".split())
_COLOUR = {"CLEAN": "32", "LOW": "36", "MEDIUM": "33", "HIGH": "31"}


def gathered(results: DataFrame, findings: DataFrame) -> list[dict[str, Any]]:
    """Entities in report order, each with its findings in order: worst first, then path and place."""
    by: dict[tuple, list[Row]] = {}
    for f in findings.collect():
        by.setdefault((f["source"], f["kind"], f["ord"]), []).append(f)
    out = []
    for r in results.collect():
        mine = sorted(by.get((r["source"], r["kind"], r["ord"]), []), key=lambda f: (-f["rank"], f["path"], f["off"], f["leaf_ord"], f["hit_ord"]))
        out.append({**r.asDict(), "findings": mine})
    return out


def _painted(band: str, text: str, colour: bool) -> str:
    return f"\x1b[{_COLOUR[band]}m{text}\x1b[0m" if colour else text


def entity_lines(r: dict[str, Any], colour: bool = False, source: bool = False) -> list[str]:
    where = f"{visible(r['source'])} / " if source and r["source"] is not None else ""
    out = [_painted(r["band"], f"{where}{r['kind']} {visible(r['label'])}  risk {r['score']}/100  [{r['band']}]", colour)]
    for f in r["findings"]:
        place = f"{visible(f['path'])} (offset {f['off']})" if f["path"] else f"offset {f['off']}"
        out += [f"  [{f['severity'].upper()}] {f['rule']}  {place}", f"      {f['message']}", f"      > {f['excerpt']}"]
    return [*out, ""]


def summary_line(rows: list[dict[str, Any]], baselined: int = 0) -> str:
    counts = [(k, sum(r["kind"] == k for r in rows)) for k in KINDS]
    seen = ", ".join(f"{n} {k}(s)" for k, n in counts if n) or "0 tool(s)"
    return f"{seen} scanned, {sum(bool(r['findings']) for r in rows)} flagged, {sum(len(r['findings']) for r in rows)} finding(s)." + f" {baselined} baselined." * bool(baselined)


def render_text(rows: list[dict[str, Any]], colour: bool = False, baselined: int = 0, source: bool = False):
    return "\n".join([*(x for r in rows for x in entity_lines(r, colour, source)), summary_line(rows, baselined)])


def render_sections(rows: list[dict[str, Any]], status: list[Row], config: str, colour: bool = False, baselined: int = 0):
    """A section for each server that was asked for, in config order, whatever became of it."""
    out: list[str] = []
    for s in status:
        mine = [r for r in rows if r["source"] == s["name"]]
        worst = max((r["band"] for r in mine), key=BANDS.index, default="CLEAN")
        out.append(_painted(worst, f"=== {visible(s['name'])} ({s['transport']}) ===", colour))
        if s["status"] != "scanned":
            out += [f"  not scanned: {'disabled in the config' if s['status'] == 'disabled' else visible(s['error'] or '')}", ""]
        elif not mine:
            out += ["  nothing listed", ""]
        for r in mine:
            out += entity_lines(r, colour)
    count = {k: sum(s["status"] == k for s in status) for k in ("scanned", "failed", "disabled")}
    roll = f"{count['scanned']} of {len(status)} server(s) in {visible(config)} scanned" + "".join(f", {count[k]} {k}" for k in ("failed", "disabled") if count[k]) + "."
    return "\n".join([*out, roll, summary_line(rows, baselined)])


def to_json(
    rows: list[dict[str, Any]], baselined: int = 0, stale: Iterable[Row] = (), drifts: Iterable[Row] = (), unchecked: Iterable[str] = (), status: Iterable[Row] = (),
) -> dict[str, Any]:
    stale, drifts, unchecked, status = list(stale), list(drifts), list(unchecked), list(status)

    def entity(r: dict[str, Any]) -> dict[str, Any]:
        hits = [{k: f[c] for k, c in (("rule", "rule"), ("severity", "severity"), ("path", "path"), ("offset", "off"), ("message", "message"), ("excerpt", "excerpt"))} for f in r["findings"]]
        return {"name": r["label"], "score": r["score"], "band": r["band"], "findings": hits} | ({} if r["source"] is None else {"source": r["source"]})

    lists = {f"{k}s": [entity(r) for r in rows if r["kind"] == k] for k in KINDS}
    more = {
        "staleBaseline": [baseline_entry(s) for s in stale],
        "pinDrift": [drift_entry(d) for d in drifts],
        "pinUnchecked": unchecked,
        "sources": [{k: s[k] for k in ("name", "transport", "status", "error")} for s in status],
    }
    totals = {k: len(x) for k, x in lists.items()}
    totals |= {"flagged": sum(bool(r["findings"]) for r in rows), "findings": sum(len(r["findings"]) for r in rows), "baselined": baselined}
    totals |= {k: len(x) for k, x in more.items()} | {"sourcesScanned": sum(s["status"] == "scanned" for s in status)}
    return {**lists, **more, "summary": totals}


_LEVEL = dict(zip("high medium low".split(), "error warning note".split()))
SARIF = "2.1.0"
SARIF_RULES = {
    "data-exfiltration": ("error", "An outbound verb sends a secret or the system prompt away."),
    "hidden-instructions": ("error", "Text that instructs the model that reads it."),
    "concealment": ("error", "A directive to keep activity from the user."),
    "invisible-characters": ("warning", "Characters that a reviewer cannot see."),
    "confusable-characters": ("error", "A Latin word with a letter of another alphabet that looks alike."),
    "compatibility-characters": ("error", "Styled characters that normalise to a payload."),
    "base64-payload": ("error", "A base64 run that decodes to a payload."),
    "hex-payload": ("error", "A hex run that decodes to a payload."),
    "injection-markup": ("warning", "Markup that a model may take for a boundary."),
    "name-collision": ("warning", "Several definitions under one name that calls are routed by."),
    "sensitive-file-access": ("error", "A directive to read a file of credentials."),
}


def to_sarif(rows: list[dict[str, Any]], uri: str | None = None, status: Iterable[Row] = (), version: str = "0.1.0") -> dict[str, Any]:
    index = {k: i for i, k in enumerate(SARIF_RULES)}

    def result(r: dict[str, Any], f: Row) -> dict[str, Any]:
        place: dict[str, Any] = {"logicalLocations": [{"fullyQualifiedName": f["path"] or r["label"], "kind": "member"}]}
        if uri is not None:
            place |= {"physicalLocation": dict(artifactLocation=dict(uri=uri))}
        where = f"{visible(r['source'])} / " if r["source"] is not None else ""
        said = f"{where}{r['kind']} {visible(r['label'])}: {f['message']}. Flagged text: {visible(f['match'])}"
        more = {} if r["source"] is None else {"source": r["source"]}
        out = {
            "ruleId": f["rule"], "level": _LEVEL.get(f["severity"], "warning"), "message": {"text": said}, "locations": [place],
            "partialFingerprints": {f"{NAME}Fingerprint/v1": f["fingerprint"]},
            "properties": {"kind": r["kind"], "target": r["label"], "score": r["score"], "band": r["band"], **more},
        }
        return out | ({"ruleIndex": index[f["rule"]]} if f["rule"] in index else {})

    rules = [dict(id=k, name=k, shortDescription=dict(text=text), defaultConfiguration=dict(level=level)) for k, (level, text) in SARIF_RULES.items()]
    run = dict(tool=dict(driver=dict(name=NAME, version=version, rules=rules)), results=[result(r, f) for r in rows for f in r["findings"]])
    if status := list(status):
        missed = [s for s in status if s["status"] != "scanned"]

        def why(s: Row) -> str:
            return visible(s["error"] or "unknown reason") if s["status"] == "failed" else "it is switched off there"

        notes = [
            dict(level="note" if s["status"] == "disabled" else "error", message=dict(text=f"server {visible(s['name'])} was not scanned: {why(s)}"))
            for s in missed
        ]
        run["invocations"] = [{"executionSuccessful": not any(s["status"] == "failed" for s in status), "toolExecutionNotifications": notes}]
    return {"$schema": f"https://json.schemastore.org/sarif-{SARIF}.json", "version": SARIF, "runs": [run]}


def dumped(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=True) + "\n"


# state files

BASELINE = "file_ord int, kind string, label string, rule string, path string, fingerprint string, excerpt string, source string"
PINS = "source string, kind string, label string, occ int, fields map<string,string>"


class StateError(ValueError):
    """A state file that cannot be used."""


def baseline_entry(r: Row) -> dict[str, Any]:
    out = {"kind": r["kind"], "target": r["label"], "rule": r["rule"], "path": r["path"], "fingerprint": r["fingerprint"], "excerpt": r["excerpt"]}
    return out | ({} if r["source"] is None else {"source": r["source"]})


def build_baseline(findings: DataFrame) -> dict[str, Any]:
    """The accepted-findings file of a scan, one entry for each fingerprint: that of the first finding in listing order."""
    order = [F.coalesce("source", F.lit("")), "kind", "label", "rule", "path", "fingerprint"]
    shown = ["kind", "label", "rule", "path", "excerpt", "source"]
    rows = findings.groupBy("fingerprint").agg(F.min_by(F.struct(*shown), F.struct("ord", "leaf_ord", "off", "hit_ord")).alias("f")).select("fingerprint", "f.*").orderBy(*order).collect()
    return {"version": 1, "findings": [baseline_entry(r) for r in rows]}


def build_pin(pins: DataFrame) -> dict[str, Any]:
    """The digest file of a scan."""
    rows = pins.orderBy(*state.state_order()).collect()
    return {"version": 1, "entities": [{"kind": r["kind"], "name": r["label"], "fields": dict(sorted(r["fields"].items()))} | ({} if r["source"] is None else {"source": r["source"]}) for r in rows]}


def drift_entry(r: Row) -> dict[str, Any]:
    out = {"kind": r["kind"], "name": r["label"], "change": r["change"], "paths": list(r["paths"])}
    return out | ({} if r["source"] is None else {"source": r["source"]})


def _entries(text: str, key: str) -> list[dict[str, Any]]:
    try:
        data = json.loads(text)
    except ValueError as e:
        raise StateError(f"not JSON: {e}") from None
    if not isinstance(data, dict) or data.get("version") != 1 or not isinstance(data.get(key), list) or not all(isinstance(x, dict) for x in data[key]):
        raise StateError(f'expected an object of version 1 with a list of objects "{key}"')
    return data[key]


def load_baseline(spark: SparkSession, text: str) -> DataFrame:
    """Accepted findings; an entry needs a fingerprint, the rest is for display."""
    rows = []
    for i, x in enumerate(_entries(text, "findings")):
        if not isinstance(x.get("fingerprint"), str):
            raise StateError(f'findings[{i}] needs a "fingerprint"')
        rows.append((i, *(x.get(k) if isinstance(x.get(k), str) else d for k, d in (("kind", "tool"), ("target", ""), ("rule", ""), ("path", ""), ("fingerprint", ""), ("excerpt", ""), ("source", None)))))
    return spark.createDataFrame(rows, BASELINE)


def load_pin(spark: SparkSession, text: str) -> DataFrame:
    """Stored digests, those of one label numbered in file order."""
    rows, seen = [], {}
    for i, x in enumerate(_entries(text, "entities")):
        fields, source = x.get("fields"), x.get("source")
        if not isinstance(x.get("kind"), str) or not isinstance(x.get("name"), str) or not (source is None or isinstance(source, str)):
            raise StateError(f'entities[{i}] needs text for "kind" and "name"')
        if not isinstance(fields, dict) or not all(isinstance(d, str) for d in fields.values()):
            raise StateError(f'entities[{i}] needs an object of digests "fields"')
        key = (source, x["kind"], x["name"])
        seen[key] = seen.get(key, 0) + 1
        rows.append((*key, seen[key], fields))
    return spark.createDataFrame(rows, PINS)


def drift_label(r: Row) -> str:
    """What changed, in one line with three paths at most."""
    where = f"{r['source']} / " if r["source"] is not None else ""
    more = f" and {len(r['paths']) - 3} more field(s)" if len(r["paths"]) > 3 else ""
    return f"{where}{r['kind']} {r['label']}: {r['change']}" + (f" ({', '.join(r['paths'][:3])}{more})" if r["paths"] else "")


def notice(head: str, lines: Iterable[str]) -> str:
    return "\n".join([f"{NAME}: {head}:", *(f"  {visible(x)}" for x in lines)])


def exit_code(failed: bool, found: bool, drifted: bool, stale: bool, stale_counts: bool) -> int:
    """2 if a server failed; else 1 for findings, drift, or, where that is asked for, stale entries; else 0."""
    return 2 if failed else int(found or drifted or (stale and stale_counts))
