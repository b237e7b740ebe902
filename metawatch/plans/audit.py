"""The audit as one plan: documents to entities, leaves, findings and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings as op
from ..operators import state
from ..sources import ingest


@dataclass
class Audit:
    """What a scan gives: entities, their string leaves, findings with fingerprints, errors of documents."""

    entities: DataFrame
    leaves: DataFrame
    findings: DataFrame
    errors: DataFrame | None = None

    def results(self, findings: DataFrame | None = None) -> DataFrame:
        """Entities with score, band and number of findings, in report order."""
        return op.rollup(self.entities.drop("payload"), self.findings if findings is None else findings).orderBy(*op.report_order())

    def pins(self) -> DataFrame:
        return state.pins(op.digests(self.entities))


def of_entities(entities: DataFrame, prefilter: bool = False) -> Audit:
    """Audit of a table of entities.  prefilter: take leaves out of Python, and only those back in that may_hit() lets by."""
    leaves = op.leaves(entities)
    keep = ["source", "kind", "ord", "label", "rule", "severity", "rank", "points", "path", "off", "len", "match", "match_raw", "excerpt", "message", "leaf_ord", "hit_ord"]
    text = (op.detect(leaves) if prefilter else op.hits_of(entities)).select(*keep)
    met = op.collisions(entities).withColumn("leaf_ord", F.lit(1 << 30)).select(*keep)
    return Audit(entities, leaves, op.fingerprints(text.unionByName(met)))


def of_documents(documents: DataFrame, prefilter: bool = False) -> Audit:
    """Audit of captured documents (source, source_ord, content)."""
    entities, errors = ingest.entities(documents)
    out = of_entities(entities, prefilter)
    out.errors = errors
    return out
