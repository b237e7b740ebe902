"""Accepted findings and content digests: joins of a scan with stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import visible
from ..functions.vocab import KINDS

UNNAMED = "(no server recorded)"


class ScopeError(ValueError):
    """A pin that cannot be held against this scan."""


def suppress(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings that are not accepted."""
    return findings.join(accepted.select("fingerprint"), "fingerprint", "left_anti")


def stale(accepted: DataFrame, findings: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Accepted entries without a finding, the first of each fingerprint; those of sources that were not scanned are left out.

    findings: before suppression.  scanned: the sources of the scan.
    """
    first = Window.partitionBy("fingerprint").orderBy("file_ord")
    once = accepted.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    if scanned is not None:
        known = scanned.select(F.col("source").alias("__s")).distinct()
        once = once.join(known, F.col("source") == F.col("__s"), "left_semi").unionByName(once.filter("source is null"))
    return once.join(findings.select("fingerprint"), "fingerprint", "left_anti")


def pins(leaves: DataFrame) -> DataFrame:
    """(source, kind, label, occ, fields): of each entity its digests by slot; occ numbers those of one label in listing order.

    leaves: with raw, or with digest.
    """
    digest = F.col("digest") if "digest" in leaves.columns else F.sha2("raw", 256)
    one = leaves.groupBy("source", "kind", "ord", "label").agg(F.map_from_entries(F.collect_list(F.struct("slot", digest))).alias("fields"))
    return one.withColumn("occ", F.row_number().over(Window.partitionBy("source", "kind", "label").orderBy("ord"))).drop("ord")


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, kind, label, occ, change, paths): entities added, removed, or changed with the slots that differ."""
    key = ["source", "kind", "label", "occ"]
    a, b = old.select(*key, F.col("fields").alias("f")).alias("a"), new.select(*key, F.col("fields").alias("f")).alias("b")
    met = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key], "full_outer")
    keys = F.array_union(F.map_keys("a.f"), F.map_keys("b.f"))
    paths = F.array_sort(F.filter(keys, lambda k: ~F.element_at("a.f", k).eqNullSafe(F.element_at("b.f", k))))
    change = F.when(F.col("a.f").isNull(), "added").when(F.col("b.f").isNull(), "removed").otherwise("changed")
    rows = met.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in key], change.alias("change"), F.when(change == "changed", paths).otherwise(F.array().cast("array<string>")).alias("paths"))
    return rows.filter((F.col("change") != "changed") | (F.size("paths") > 0))


def state_order() -> list[Column]:
    """The order of pins and drifts: by source, kind as in reports with unknown ones last, label and occurrence."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return [F.coalesce("source", F.lit("")).asc(), F.when(place > 0, place).otherwise(len(KINDS) + 1).asc(), F.when(place > 0, "").otherwise(F.col("kind")).asc(), F.asc("label"), F.asc("occ")]


def scope(pinned: DataFrame, scanned: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(pins to compare, sources that were pinned and not scanned).

    scanned: the named sources of the scan, None for a scan of one source without a name, which any pin of one
    source fits.  A pin that names no source at all is taken over by the one source of the scan.  Raises where the
    pin cannot be lined up: several sources in it and none named here, none named in it and not one here, or
    none in common.  Only names of sources come to the driver, two at most but for a message.
    """
    names = pinned.select("source").distinct()
    first = [r["source"] for r in names.limit(2).collect()]
    if not first:
        return pinned, names
    if scanned is None:
        if len(first) > 1:
            raise ScopeError(f"the pin is one of several servers, {_listed(names)}; hold it against their --config, with --server for one of them")
        return pinned.withColumn("source", F.lit(None).cast("string")), names.limit(0)
    known = scanned.select(F.col("source").alias("__s")).distinct()
    if first == [None]:
        one = [r["__s"] for r in known.limit(2).collect()]
        if len(one) != 1:
            raise ScopeError("the pin names no server and this scan is not one of one server; --server says whose it is, --write-pin makes one of all")
        return pinned.withColumn("source", F.lit(one[0])), names.limit(0)
    kept = pinned.join(known, F.col("source") == F.col("__s"), "left_semi")
    left = names.join(known, F.col("source") == F.col("__s"), "left_anti")
    if not kept.take(1):
        raise ScopeError(f"no server of the pin is in this scan; it has {_listed(names)}")
    return kept, left


def _listed(names: DataFrame) -> str:
    return ", ".join(sorted(visible(UNNAMED if r["source"] is None else r["source"]) for r in names.collect()))
