"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from oracle import same
from pyspark.sql import functions as F

from metawatch.llm import bpe, classifier, fingerprints, jaccard, langid, packing, quality, queries, sharding, substrings, textarrays, warc

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(0, None, "en", "s"), (1, "", None, "s"), (2, LONG, "en", "s"), (3, "one two", "en", None), (3, "one two", "en", None), (None, "no id here", "fr", "t"), (5, "one two", "en", "s"), (6, " \n\t ", "en", "s"), (7, "\U0001f600 é ß", "de", "u")]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, empty and long texts, ties and repeats, and columns named like those of the operators."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    for c in ("shard", "pos", "keep", "words", "ids", "token", "doc", "grp", "cut_words", "spans", "start", "n_chars", "bin", "similarity"):
        df = df.withColumn(c, F.lit(-1))
    return df


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL)


# words and hashes


def test_words_and_hashes_are_those_of_plain_python():
    texts = ["a bb  a", None, "", "é-bb", "bb"]
    data, off = textarrays.raw(textarrays.strings(pa.array(texts)))
    s, e, w = textarrays.words(data, off, textarrays.SPACED)
    got = [[data[s[i] : e[i]].tobytes().decode() for i in range(w[t], w[t + 1])] for t in range(5)]
    assert got == [(t or "").split() for t in texts]
    h = textarrays.hash_spans(data, s, e)
    flat = sum(got, [])
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i, j in itertools.product(range(len(flat)), repeat=2))
    g = textarrays.hash_grams(np.array([1, 2, 1, 2, 3], np.uint64), 2)
    assert g[0] == g[2] and len({int(x) for x in g}) == 3


def test_runs_keep_keys_whole():
    rng = np.random.default_rng(1)
    k = np.sort(rng.integers(0, 40, 500))
    batches = [pa.record_batch({"k": k[i : i + 7]}) for i in range(0, 500, 7)]
    parts = [t.column("k").to_pylist() for t in textarrays.runs(iter(batches), "k", 20)]
    assert sum(parts, []) == k.tolist() and all(not set(a) & set(b) for a, b in itertools.combinations(parts, 2)) and len(parts) > 5


# 1 sharding


def test_sort_odd_rows(odd):
    rows = sharding.histogram_sort(odd, least_shards=3).collect()
    assert len(rows) == len(ODD) and {r["shard"] for r in rows} <= {0, 1, 2}
    order = [(r["source"] or "", r["doc_id"] if r["doc_id"] is not None else -1) for r in sorted(rows, key=lambda r: (r["shard"], r["pos"]))]
    assert order == sorted(order)
    assert sharding.histogram_sort(odd.limit(0)).count() == 0
    clash = odd.withColumn("__key", F.lit(7)).withColumn("__shard", F.lit(8)).withColumn("__bytes", F.lit(9))
    got = sharding.histogram_sort(clash, least_shards=3)
    assert {"__key", "__shard", "__bytes"} <= set(got.columns) and {(r["__key"], r["__shard"], r["__bytes"]) for r in got.collect()} == {(7, 8, 9)}


@pytest.mark.parametrize("tolerance", [0.0, 0.05])
def test_cuts_are_as_even_as_asked(spark, tolerance):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.randrange(300), "x" * rng.randrange(50)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int, text string").repartition(5)
    got = sharding.histogram_sort(df, ("a", "b"), least_shards=7, tolerance=tolerance, probes=4).collect()
    total, size = sum(len(t) for *_, t in rows), {}
    for a, b, t in rows:
        size[a, b] = size.get((a, b), 0) + len(t)
    below = dict(zip(sorted(size), itertools.accumulate([0, *(size[k] for k in sorted(size))])))
    for r in got:
        exact = below[r["a"], r["b"]] * 7 / total
        assert r["shard"] == min(int(exact), 6) if not tolerance else r["shard"] - tolerance <= exact + size[r["a"], r["b"]] * 7 / total and exact <= r["shard"] + 1 + tolerance


# 2 packing


def fewest(sizes, room):
    best = [len(sizes)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= room:
                put(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_packing_is_optimal(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 60) if seed % 2 else rng.choice([51, 27, 26, 23, 24, 25, 49, 33, 34]) for _ in range(9)), reverse=True)
    got = packing.complete(sizes, 100, 10_000)
    assert sorted(sum(got, [])) == list(range(9)) and all(sum(sizes[i] for i in b) <= 100 for b in got)
    assert len(got) == fewest(sizes, 100) <= len(packing.best_fit(sizes, 100))


def test_search_beats_best_fit():
    sizes = [6, 5, 5, 4, 4, 3, 3]  # best fit needs more than the optimum for some sets like this one
    better = [s for s in itertools.combinations_with_replacement(range(2, 9), 8) if len(packing.best_fit(sorted(s, reverse=True), 10)) > len(packing.complete(sorted(s, reverse=True), 10, 5000))]
    assert better and len(packing.complete(sizes, 10, 5000)) == 3


@pytest.mark.parametrize("seed", [0, 2])
def test_packing_of_mid_sized_texts_goes_past_one_dive(seed):
    r, room, sizes = random.Random(seed), 200, []
    for _ in range(24):  # full bins of two or three
        if r.choice((2, 3, 3)) == 2:
            a = r.randint(room * 2 // 5, room // 2)
            sizes += [a, room - a]
        else:
            a, b = r.randint(room // 4, room * 2 // 5), r.randint(room // 4, room * 2 // 5)
            sizes += [a, b, room - a - b]
    sizes.sort(reverse=True)
    got = packing.complete(sizes, room, 500)
    assert sorted(i for b in got for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= room for b in got)
    assert len(got) == 24 < len(packing.best_fit(sizes, room))


def test_pack_odd_rows(odd):
    rows = packing.pack(odd, 1000, 5000).collect()
    assert packing.pack(odd.limit(0)).count() == 0
    want = {}
    for d, t, *_ in ODD:
        if t:
            want[d] = want.get(d, 0) + len(t)
    got, bins = {}, {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        bins.setdefault((r["bin_group"], r["bin"]), []).append((r["at"], r["length"]))
    assert got == want
    assert all(sum(n for _, n in b) <= 1000 and all(x[0] + x[1] == y[0] for x, y in itertools.pairwise(sorted(b))) for b in bins.values())


def test_packing_keeps_ids_as_they_are_and_says_what_is_proven(spark):
    big = 1152921504606846977
    rows = packing.pack(spark.createDataFrame([(big, "a" * 30), (None, "b" * 40), (big, None)], "doc_id long, text string"), 100).collect()
    assert sorted((r["doc_id"] or 0, r["length"], r["proven"]) for r in rows) == [(0, 40, True), (big, 30, True)]
    words = packing.pack(spark.createDataFrame([("x", "a" * 250, 1)], "doc_id string, text string, bin int"), 100).collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in words) == [("x", 0, 100), ("x", 100, 100), ("x", 200, 50)]
    mid = spark.createDataFrame([(i, "a" * n) for i, n in enumerate([51, 27, 26, 23, 24, 25, 49, 33, 34, 41, 42, 17, 19] * 4)], "doc_id long, text string")
    assert not all(r["proven"] for r in packing.pack(mid, 100, 10**6, 0).collect())


# 3 quality rules


def test_quality_takes_words_of_one_count_in_byte_order(spark):
    text = " ".join(f"{w} {w}" for w in ("bb", "aa", "é", "zz")) + " cc cc cc"
    refs = quality.references(spark.createDataFrame([(text, "en"), ("q q", None)] * 2, "text string, lang string").repartition(3), 3)
    assert refs["en"][1:] == ([("cc", 6), ("aa", 4), ("bb", 4)], 22) and refs[None][1:] == ([("q", 4)], 4)


def test_quality_of_odd_rows(odd, spark):
    rows = {r["doc_id"]: r for r in quality.divergence_rules(odd).collect()}
    assert len(rows) == 8 and rows[0]["keep"] and rows[1]["keep"] and (rows[3]["char_js"], rows[3]["word_js"]) == (0, 0)
    assert quality.divergence_rules(odd.limit(0)).count() == 0 and quality.passing(odd.limit(0)).count() == 0
    assert quality.passing(odd).columns == odd.columns


def test_quality_rejects_junk_and_keeps_clean(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality.divergence_rules(docs).join(labels, "doc_id").collect()
    clean = [r["keep"] for r in rows if r["quality"] == 1]
    assert np.mean(clean) > 0.98 and np.mean([r["keep"] for r in rows if r["quality"] == 0]) < 0.8
    assert {r["doc_id"] for r in quality.passing(docs).collect()} == {r["doc_id"] for r in quality.divergence_rules(docs).filter("keep").collect()}


# 4 archive


def test_archive_keeps_each_payload_once(spark):
    pages = spark.createDataFrame([(1, "u", "<p>"), (2, "v", "<p>"), (2, "v", "<p>"), (3, None, None), (4, "w", ""), (None, "x", "é" * 50_000)], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    recs = warc.records(pages)
    headers, payloads = warc.archive(recs)
    assert (headers.count(), payloads.count()) == (6, 3)
    key = lambda r: (r["page_id"] or 0, bytes(r["record"]))
    assert sorted(map(key, warc.restore(headers, payloads).collect())) == sorted(map(key, recs.collect()))
    broken = payloads.withColumn("size", F.col("size") + 1)
    with pytest.raises(Exception, match="damaged|size"):
        warc.restore(headers, broken).collect()
    bare = spark.createDataFrame([(1, b"no body"), (2, None)], "page_id int, record binary")
    assert sorted(bytes(r["record"]) for r in warc.restore(*warc.archive(bare)).collect()) == [b"", b"no body"]
    assert warc.restore(*warc.archive(recs.limit(0))).count() == 0


# 5 classifier, 6 language identification


def labelled(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


def test_classifier_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    chosen = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(250).collect()]
    rows = classifier.classify(docs, labels, train_rows=250).join(labels.withColumnRenamed("toxic", "is_toxic"), "doc_id").collect()
    held = [r for r in rows if r["doc_id"] not in set(chosen)]
    assert len(held) > 100
    assert np.mean([(r["good"] > 0.5) == (r["quality"] == 1) for r in held]) > 0.85
    assert np.mean([r["keep"] for r in held if (r["quality"], r["is_toxic"]) == (1, 0)]) > 0.95


def test_classifier_odd_rows(odd, spark):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (5, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert classifier.classify(odd, labels).count() == len(ODD)
    assert all(r["keep"] for r in classifier.classify(odd, labels.limit(0)).collect()) and classifier.classify(odd.limit(0), labels).count() == 0


def test_classifier_takes_labels_that_are_none(spark):
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 5, 0), (1, -1, 1), (2, 1, 7), (3, 1, 0), (3, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert classifier.classify(docs, labels).count() == 6 and classifier.classify(docs, labels.filter("quality = 5")).filter("keep").count() == 6


def test_averages_are_those_of_counting():
    rng = random.Random(4)
    texts = pa.array([" ".join(rng.choice(["one", "two", "three", "é%"]) for _ in range(rng.randint(0, 30))) for _ in range(700)] + [None, ""])
    off, b, w = classifier.averages(texts)
    assert len(off) == len(texts) + 1
    for i in (0, 5, 300, 699, 700, 701):
        woff, place, of, feature = classifier.features(texts.slice(i, 1))
        want = {}
        for p in place.tolist():
            for f in feature[of == p].tolist():
                want[f] = want.get(f, 0) + 1
        total = sum(want.values())
        got = dict(zip(b[off[i] : off[i + 1]].tolist(), w[off[i] : off[i + 1]].tolist()))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k] / total) < 1e-6 for k in want)


def test_training_separates_what_can_be():
    texts = pa.array([f"good {i}" for i in range(60)] + [f"vile {i}" for i in range(60)])
    table, bias = classifier.train(texts, np.array([2] * 60 + [1] * 60))
    assert (classifier.score(texts, table, bias).argmax(1) == [2] * 60 + [1] * 60).all()


def test_fast_score_is_that_of_the_averages():
    rng = np.random.default_rng(0)
    table, bias = rng.normal(size=(classifier.BUCKETS, 4)), rng.normal(size=4)
    texts = pa.array(["one two one", "", None, "thr%%% é"])
    off, b, w = classifier.averages(texts)
    slow = np.stack([(table[b[off[i] : off[i + 1]]] * w[off[i] : off[i + 1], None]).sum(0) for i in range(4)])
    assert np.allclose(classifier.score(texts, table, bias), classifier.softmax(slow + bias), atol=1e-5)


def test_language_on_held_out_documents(spark):
    docs, _ = labelled(spark)
    fitted = docs.withColumn("n", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter("n <= 50").select("doc_id")
    held = langid.identify(docs, rows_per_language=50).join(docs.select("doc_id", "lang"), "doc_id").join(fitted, "doc_id", "left_anti").collect()
    assert len(held) > 500 and np.mean([r["language"] == r["lang"] for r in held if r["keep"]]) > 0.97 and np.mean([r["keep"] for r in held]) > 0.95


def test_language_against_slow_cosines(spark):
    docs, _ = labelled(spark)
    docs = docs.limit(200)
    idf, centres, names = langid.fit(docs, 20, 2)
    slow = {}
    for r in docs.collect():
        counts = {}
        data = "".join(c for c in (r["text"] or "").lower()).encode()
        c = [x if 97 <= x <= 122 or x >= 128 else 32 for x in data]
        for i in range(len(c) - 2):
            if c[i + 1] != 32 and (c[i] != 32 or c[i + 2] != 32):
                code = (c[i] << 16) | (c[i + 1] << 8) | c[i + 2]
                at = (code * 0x9E3779B97F4A7C15 % (1 << 64)) >> 52
                counts[at] = counts.get(at, 0) + 1
        v = np.zeros(langid.PLACES)
        for k, n in counts.items():
            v[k] = np.log1p(n) * idf[k]
        cos = centres @ v / max(np.linalg.norm(v), 1e-9)
        slow[r["doc_id"]] = (names[int(cos.argmax())], float(cos.max()), sum(counts.values()))
    got = {r["doc_id"]: r for r in langid.identify(docs, 20, 2).collect()}
    for d, (lang, cos, n) in slow.items():
        assert abs(got[d]["similarity"] - cos) < 2e-4
        if got[d]["keep"]:
            assert got[d]["language"] == lang
        assert got[d]["keep"] == (n > 0 and round(cos, 4) >= langid.limit(np.array([n]), 0.4, 400)[0]) or abs(cos - langid.limit(np.array([n]), 0.4, 400)[0]) < 2e-4


def test_language_of_ties_and_of_one_id(spark):
    same = spark.createDataFrame([(i, "the very same words here", lang) for i, lang in enumerate("ba" * 4)] + [(99, "the very same words here", "a")] * 50, "doc_id long, text string, lang string")
    assert {r["language"] for r in langid.identify(same, 4).collect()} == {"a"}


def test_language_rejects_what_is_none(spark):
    docs, _ = labelled(spark)
    odd = spark.createDataFrame([(-1, "zq xj vk " * 200, None), (-2, "1234 5678 " * 50, None), (-3, None, None)], "doc_id long, text string, lang string")
    rows = langid.identify(docs.select("doc_id", "text", "lang").unionByName(odd)).filter("doc_id < 0").collect()
    assert len(rows) == 3 and not any(r["keep"] or r["language"] for r in rows)


def test_language_odd_rows(odd):
    assert langid.identify(odd).count() == len(ODD) and langid.identify(odd.limit(0)).count() == 0
    assert not any(r["keep"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert langid.accepted(odd).columns == odd.columns and langid.accepted(odd).count() == langid.identify(odd).filter("keep").count()


# 7 BPE


@pytest.mark.parametrize("block_bytes", [16 << 20, 20_000])
def test_bpe_is_that_of_the_library_and_turns_back(odd, spark, block_bytes):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN.replace("(?U)", ""), mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})
    texts = spark.createDataFrame([(20, "It's  two  x y \r\n\n 12a ́e"), (21, "'LL's " * 50)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(texts)
    rows = bpe.decode(bpe.encode(docs.withColumn("was", F.col("text")), VOCABULARY, ("doc_id", "was"), block_bytes), VOCABULARY, ("was", "ids")).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert r["text"] == (r["was"] or "") and r["ids"] == own.encode_ordinary(r["was"] or "")
    assert bpe.encode(docs.limit(0), VOCABULARY, block_bytes=block_bytes).count() == 0


def test_bpe_decodes_odd_ids(spark):
    pieces = {i: x for x, i in bpe.load_ranks(VOCABULARY).items()}
    rows = spark.createDataFrame([(1, [10**6, None, -3, 257, 50, max(pieces) + 1]), (2, None), (3, [])], "doc_id int, ids array<int>")
    assert [r["text"] for r in bpe.decode(rows, VOCABULARY).orderBy("doc_id").collect()] == [(pieces[257] + pieces[50]).decode("utf-8", "replace"), "", ""]


def test_bpe_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b", 5, 6, 7), (2, None, 8, 9, 10)], "doc_id int, text string, words int, data int, `to` int")
    got = bpe.encode(rows, VOCABULARY, ("doc_id", "words", "data", "to", "text"))
    assert got.columns == ["doc_id", "words", "data", "to", "text", "ids"]
    assert sorted((r["doc_id"], r["words"], r["data"], r["to"], r["text"], len(r["ids"])) for r in got.collect()) == [(1, 5, 6, 7, "a b", 2), (2, 8, 9, 10, None, 0)]


# 8 substrings


def slow_cut(docs, least):
    """Positions of every window of ``least`` words that an earlier document has."""
    first, out = {}, {}
    for d, t in sorted(docs):
        w = t.split()
        for i in range(len(w) - least + 1):
            first.setdefault(tuple(w[i : i + least]), d)
    for d, t in docs:
        w = t.split()
        gone = {i + j for i in range(len(w) - least + 1) if first[tuple(w[i : i + least])] < d for j in range(least)}
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_substrings_against_all_windows(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}.{i}" if seed % 2 else rng.choice("ab") for i in range(rng.randint(4, 30))] for k in range(6)]
    docs = []
    for d in range(40):
        w = []
        for _ in range(rng.randint(0, 6)):
            p = list(rng.choice(passages)) if rng.random() < 0.6 else [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            if rng.random() < 0.3 and p:
                p[rng.randrange(len(p))] = "x"
            w += p
        docs.append((d, " ".join(w)))
    got = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), least=8, shard_words=40).collect()
    assert {r["doc_id"]: r["text"].split() for r in got} == slow_cut(docs, 8)


def test_substrings_odd_rows(odd, spark):
    rows = substrings.remove_repeats(odd).collect()
    assert len(rows) == len(ODD) and {(r["doc_id"], r["text"]) for r in rows} == {(d, t) for d, t, *_ in ODD} and all(r["cut_words"] == 0 for r in rows)
    assert substrings.remove_repeats(odd.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, LONG), (2, "x\n" + LONG + "\ny"), (2, "x\n" + LONG + "\ny")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"], r["cut_words"]) for r in substrings.remove_repeats(twice).collect()) == [(1, LONG, 0), (2, "x\ny", 30_000), (2, "x\ny", 30_000)]


def test_unlike_texts_under_one_id_are_cut_each_for_itself(spark, monkeypatch):
    p, tail, other = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("p", 80), ("t", 10), ("o", 120)))
    rows = [(1, p, 0, 0, 0), (2, p + " " + tail, 0, 0, 0), (2, other, 0, 0, 0), (3, "x " + other, 0, 0, 0), (None, p, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int, `mark` int, spans int")
    for lot in (substrings.LOT, 1):
        monkeypatch.setattr(substrings, "LOT", lot)
        got = substrings.remove_repeats(docs)
        assert got.columns == [*docs.columns, "cut_words"]
        assert sorted((r["doc_id"] or 0, r["text"], r["cut_words"]) for r in got.collect()) == [(0, p, 0), (1, p, 0), (2, other, 0), (2, tail, 80), (3, "x ", 120)]


@pytest.mark.parametrize("seed", range(10))
def test_automaton_knows_every_substring(seed):
    rng = random.Random(seed)
    made, refs = substrings.SuffixAutomaton(), [[rng.randrange(3) for _ in range(rng.randint(1, 25))] for _ in range(5)]
    for d, r in enumerate(refs):
        made.add(r, d)
    made.finish()
    q = [rng.randrange(3) for _ in range(40)]
    for doc in range(6):
        want = set()
        for i, j in itertools.combinations(range(41), 2):
            if j - i >= 4 and any(q[i:j] == r[k : k + j - i] for d, r in enumerate(refs) if d < doc for k in range(len(r))):
                want |= set(range(i, j))
        assert {i for a, z in made.covered(q, doc, 4) for i in range(a, z)} == want


# 9 fingerprints


@pytest.mark.parametrize("seed", range(5))
def test_sketches_find_all_differences(seed):
    rng = np.random.default_rng(seed)
    old = [set(rng.integers(0, 1 << 60, rng.integers(0, 200)).tolist()) for _ in range(50)]
    new = [{x for x in s if rng.random() < 0.8} | set(rng.integers(0, 1 << 60, rng.integers(0, 30)).tolist()) for s in old]
    pair, key, sign, cells = fingerprints.differences(old, new, 6)
    got = {(int(p), int(k), int(s)) for p, k, s in zip(pair, key, sign)}
    assert got == {(i, x, 1) for i in range(50) for x in old[i] - new[i]} | {(i, x, -1) for i in range(50) for x in new[i] - old[i]} and len(got) == len(pair)
    assert len(set(cells)) > 1


def test_fingerprints_odd_rows(odd):
    masked = F.regexp_replace("text", "[0-9]+", "0")
    rows = fingerprints.changed_paragraphs(odd, F.col("text"), masked).collect()
    assert sorted((r["doc_id"], r["side"]) for r in rows) == [(2, "added"), (2, "removed")]
    assert fingerprints.changed_paragraphs(odd.limit(0), F.col("text"), masked).count() == 0


# 10 Jaccard join


def slow_pairs(docs, n, limit):
    sets = {}
    for d, t in docs:
        w = "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in t.lower()).split()
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= limit}


def slow_classes(docs, n, limit):
    """(least id that can be reached, number of partners) of each document."""
    links = slow_pairs(docs, n, limit)
    root, many = {d: d for d, _ in docs}, dict.fromkeys((d for d, _ in docs), 0)
    for a, b in links:
        many[a] += 1
        many[b] += 1
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return {d: (root[d], many[d]) for d in root}


SMALL_ROOMS = {"block": 3, "lot": 4, "hot": 4, "place": 500}


@pytest.mark.parametrize(("limit", "sizes"), [(0.6, {}), (0.8, SMALL_ROOMS), (0.5, {"block": 2, "lot": 3, "hot": 2, "place": 300}), (0.2, {"hot": 3, "place": 1000}), (1.0, SMALL_ROOMS)])
def test_classes_against_all_pairs(spark, limit, sizes):
    rng = random.Random(3)
    docs = []
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 5, 20, 60, 300, 900]))]
        for _ in range(rng.choice([1, 2, 8])):
            docs.append((len(docs), " ".join(w if rng.random() > 0.06 else f"e{rng.randrange(10**6)}" for w in base)))
    docs += [(1000 + i, docs[i % 7][1]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = slow_classes(docs, 3, limit)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.similar_classes(df, 3, limit, **sizes).collect()}
    assert got == want and any(n for _, n in want.values())


def test_classes_of_odd_rows(odd, spark):
    rows = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.similar_classes(odd).collect()}
    assert rows == {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (3, 1), 5: (3, 1), 6: (6, 0), 7: (7, 0)}
    assert jaccard.similar_classes(odd.limit(0)).count() == 0 and jaccard.one_of_each_group(odd.limit(0)).count() == 0
    left = jaccard.one_of_each_group(odd)
    assert left.columns == odd.columns and sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, -1, 1, 2, 3, 3, 6, 7]
    unlike = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (3, "e f g h")], "doc_id long, text string")
    assert sum(r["links"] for r in jaccard.similar_classes(unlike).collect()) == 2  # one of its two texts stands for document 1
    for limit in (0, 1.5):
        with pytest.raises(ValueError, match="limit"):
            jaccard.similar_classes(odd, limit=limit)


def test_a_group_may_have_all_documents(spark):
    """A third of all rows in near copies of one text, and a third in copies of another."""
    rng = random.Random(8)
    base, other = [f"b{i}" for i in range(60)], " ".join(f"o{i}" for i in range(40))
    docs = [(i, " ".join(w if j != i % 60 else f"x{i}" for j, w in enumerate(base))) for i in range(80)] + [(100 + i, other) for i in range(80)] + [(200 + i, " ".join(f"y{rng.randrange(9999)}" for _ in range(30))) for i in range(80)]
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"), block=16, lot=16, hot=32, place=2000).collect()}
    assert got == slow_classes(docs, 3, 0.6) and got[100] == (100, 79)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["doc"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect()}
    assert got == {k: v for k, v in root.items() if k in got} and {k for k, v in root.items() if k != v} <= set(got)
