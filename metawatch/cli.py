"""Command line: audits captured listings and gates on what it finds."""

from __future__ import annotations

import argparse
import math
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.render import visible
from .functions.vocab import SEVERITY
from .operators import findings as op
from .operators import state
from .plans import audit, report
from .sources import config as cfg
from .sources import live, transports


def _seconds(text: str) -> float:
    value = float(text)
    if not math.isfinite(value) or value <= 0:
        raise argparse.ArgumentTypeError("must be a finite number of seconds above 0")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=report.NAME, description=__doc__)
    p.add_argument("path", nargs="?", help="a captured listing, or - for standard input")
    lists = {"manifest": "a captured listing", "server": "one of the servers of --config", "header": "NAME: VALUE, for --http and --sse"}
    for flag, said in lists.items():
        p.add_argument(f"--{flag}", default=[], action="append", help=f"{said}; may be given several times")
    p.add_argument("--config", help="a client configuration")
    p.add_argument("--stdio", nargs=argparse.REMAINDER, help="a command to launch")
    p.add_argument("--http", help="a server's URL")
    p.add_argument("--sse", help="a server's URL, older transport")
    p.add_argument("--timeout", type=_seconds, help="seconds for each live server")
    p.add_argument("--fail-on", choices=list(SEVERITY), default="medium")
    for flag in ("--baseline", "--write-baseline", "--pin", "--write-pin"):
        p.add_argument(flag)
    for flag in ("--fail-on-stale-baseline", "--json", "--sarif", "--no-color"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--version", version="0.1.0", action="version")
    return p


def checked(args: argparse.Namespace) -> str | None:
    """What is wrong with a combination of options, if anything is."""
    sources = [bool(args.path), bool(args.manifest), bool(args.config), args.stdio is not None, bool(args.http), bool(args.sse)]
    rules = [
        (sum(sources) != 1, "give exactly one kind of source"),
        (len(args.manifest) > 1 and "-" in args.manifest, "standard input cannot be one of several manifests"),
        (len(set(args.manifest)) < len(args.manifest), "a manifest is given twice"),
        (bool(args.server) and not args.config, "--server needs --config"),
        (bool(args.header) and not (args.http or args.sse), "--header needs --http or --sse"),
        (args.timeout is not None and not (args.config or args.stdio is not None or args.http or args.sse), "--timeout needs a live source"),
        (bool(args.json and args.sarif), "--json and --sarif exclude each other"),
        (bool((args.baseline or args.pin) and (args.write_baseline or args.write_pin)), "judging by state files and writing them exclude each other"),
        (args.fail_on_stale_baseline and not args.baseline, "--fail-on-stale-baseline needs --baseline"),
    ]
    return next((said for wrong, said in rules if wrong), None)


def main(argv: list[str], spark: SparkSession, fetch: live.Fetcher | None = None, say: Callable[[str], None] = print, warn: Callable[[str], None] | None = None) -> int:
    """Run with these arguments; fetch: asks live servers in place of the fetchers of this package."""
    warn = warn or (lambda x: print(x, file=sys.stderr))
    args = parser().parse_args(argv)
    try:
        if wrong := checked(args):
            raise ValueError(wrong)
        return _run(args, spark, fetch or transports.fetch, say, warn)
    except (ValueError, OSError) as e:
        warn(f"{report.NAME}: {e}")
        return 2


def _scan(args: argparse.Namespace, spark: SparkSession, fetch: live.Fetcher, warn: Callable[[str], None]):
    status = None
    if args.path or args.manifest:
        paths = args.manifest or [args.path]
        texts = [sys.stdin.read() if p == "-" else open(p, encoding="utf-8").read() for p in paths]
        rows = [(p if len(paths) > 1 else None, i, t) for i, (p, t) in enumerate(zip(paths, texts))]
        scan = audit.of_documents(spark.createDataFrame(rows, "source string, source_ord int, content string"))
        if bad := scan.errors.orderBy("source_ord").first():
            raise ValueError(f"{paths[bad['source_ord']]}: {bad['error']}")
        return scan, status
    if args.config:
        servers = cfg.select(cfg.load_config(args.config), args.server)
    elif args.stdio is not None:
        servers = [cfg.Server("", "stdio", args.stdio[0], args.stdio[1:])]
    else:
        url = args.http or args.sse
        live.check_url(url)
        servers = [cfg.Server("", "http" if args.http else "sse", url=url, headers=live.parse_headers(args.header))]
    for s in servers:
        if s.url and s.headers and not s.disabled and live.cleartext(s.url):
            warn(f"{report.NAME}: warning: {len(s.headers)} header(s) go to {visible(live.origin(s.url)[1])} in the clear; https would hide them")
    entities, status = live.read_live(spark, servers, fetch, args.timeout or 20.0)
    if not args.config:
        entities = entities.withColumn("source", F.lit(None).cast("string"))
    return audit.of_entities(entities), status


def _run(args: argparse.Namespace, spark: SparkSession, fetch: live.Fetcher, say: Callable[[str], None], warn: Callable[[str], None]) -> int:
    scan, status_df = _scan(args, spark, fetch, warn)
    scan.findings = scan.findings.persist()
    status = status_df.orderBy("source_ord").collect() if status_df is not None else []
    failed = any(s["status"] == "failed" for s in status)
    if status and not any(s["status"] == "scanned" for s in status) and (args.baseline or args.pin or args.write_baseline or args.write_pin):
        raise ValueError("no server was read, so there is nothing to judge or to write")
    if args.write_baseline or args.write_pin:
        if failed:
            raise ValueError("a server failed; a state file of the others would pass for whole")
        for path, made in ((args.write_baseline, lambda: report.build_baseline(scan.findings)), (args.write_pin, lambda: report.build_pin(scan.pins()))):
            if path:
                with open(path, "w", encoding="utf-8") as f:
                    f.write(report.dumped(made()))
        return 0
    findings, stale, drifts, unchecked, accepted = scan.findings, [], [], [], 0
    sources = scan.entities.select("source").distinct() if status_df is None else status_df.filter("status = 'scanned'").select(status_df["name"].alias("source"))
    if args.pin:
        named = bool(args.config) or len(args.manifest) > 1
        kept, left = state.scope(report.load_pin(spark, open(args.pin, encoding="utf-8").read()), sources if named else None)
        drifts = state.drift(kept, scan.pins()).orderBy(*state.state_order()).collect()
        unchecked = sorted(state.UNNAMED if r["source"] is None else r["source"] for r in left.collect())
    if args.baseline:
        known = report.load_baseline(spark, open(args.baseline, encoding="utf-8").read())
        stale = state.stale(known, findings, sources).orderBy("file_ord").collect()
        before = findings.count()
        findings = state.suppress(findings, known)
        accepted = before - findings.count()
    rows = report.gathered(scan.results(findings), findings)
    if args.json:
        say(report.dumped(report.to_json(rows, accepted, stale, drifts, unchecked, status)))
    elif args.sarif:
        say(report.dumped(report.to_sarif(rows, args.path if args.path not in (None, "-") else None, status if args.config else ())))
    elif args.config:
        say(report.render_sections(rows, status, args.config, not args.no_color, accepted))
    else:
        say(report.render_text(rows, not args.no_color, accepted, len(args.manifest) > 1))
    for lines, head in (
        ([f"{s['name']}: {s['error'] or 'disabled in the config'}" for s in status if s["status"] != "scanned"], "servers that were not scanned"),
        ([f"{s['kind']} {s['label']} {s['rule']} {s['path']}" for s in stale], "baseline entries that match nothing in this scan"),
        ([report.drift_label(d) for d in drifts], "entities that no longer match the pin"),
        (unchecked, "pinned servers that this run did not scan"),
    ):
        if lines:
            warn(report.notice(head, lines))
    return report.exit_code(failed, bool(op.gate(findings, args.fail_on).take(1)), bool(drifts), bool(stale), args.fail_on_stale_baseline)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], SparkSession.builder.appName(report.NAME).getOrCreate()))
