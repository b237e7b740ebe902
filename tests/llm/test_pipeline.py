"""The pipeline against slow versions of its stages, and its decisions on planted documents."""

import itertools
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_operators import slow_cut, slow_pairs

import corpus_pipeline as cp
from metawatch.llm import langid, quality
from metawatch.llm.shared import written


@pytest.fixture(scope="module")
def planted(spark):
    """The small documents with an exact copy, a near copy, a shared passage of 80 words and texts in no language."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id")
    clean = [r for r in docs.join(good, "doc_id").filter("n_chars > 3000 and lang = 'en' and text not like '%|%'").orderBy("doc_id").collect() if r["text"].count(" ") > 400 and "%" not in r["text"]]
    a, b, c, d = (r["text"].split(" ") for r in clean[:4])
    rng = random.Random(1)
    near = [w if rng.random() > 0.02 else "zz" for w in a]
    passage = b[100:180]
    rows = [
        (10_000, " ".join(a), "en", "x"), (10_001, " ".join(near), "en", "x"), (10_002, " ".join(c[:200] + passage + c[200:260]), "en", "x"), (10_003, "zq xj vk " * 100, "en", "x"),
        (10_004, " ".join(f"%%{w}##" for w in d), "en", "x"), (10_005, None, "en", "x"), (10_006, "", None, None),
    ]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return docs.unionByName(more.select(docs.columns)), passage, clean


def test_stages_against_slow_versions(spark, planted):
    docs, passage, clean = planted
    seen = []
    for name, stage in cp.STAGES:
        seen.append(docs)
        docs = written(stage(spark, docs, SMALL), name)
        if name != "best_fit_packing":
            assert docs.columns == seen[0].columns
    after = seen[1:] + [docs]
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    assert ids(after[0]) == ids(langid.identify(seen[0]).filter("keep")) and not {10_003, 10_005, 10_006} & set(ids(after[0]))
    assert ids(after[1]) == ids(quality.divergence_rules(seen[1]).filter("keep")) and 10_004 not in ids(after[1])
    rows = [(r["doc_id"], r["text"]) for r in seen[2].collect()]
    root = {d: d for d, _ in rows}
    links = slow_pairs(rows, 3, 0.6)
    for _ in range(len(rows)):
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not moved:
            break
    assert ids(after[2]) == sorted(d for d, r in root.items() if d == r) and not {10_000, 10_001} & set(ids(after[2]))
    rows = [(r["doc_id"], r["text"]) for r in seen[3].collect()]
    cut = {r["doc_id"]: r["text"] for r in after[3].collect()}
    assert {d: t.split() for d, t in cut.items()} == slow_cut(rows, 50)
    assert " ".join(passage[5:70]) not in cut.get(10_002, "")
    kept = {}
    for r in after[4].collect():
        kept[r["doc_id"]] = kept.get(r["doc_id"], 0) + r["length"]
    assert kept == {d: len(t) for d, t in cut.items() if t}
    first = {r["doc_id"] for r in clean}
    assert len(first & set(ids(after[1]))) == len(first & set(ids(seen[0])))


def test_run_gives_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(cp.run(spark, SMALL)) == key(docs)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
    assert docs.count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names) and len(list(itertools.chain(names))) == len(set(names))
