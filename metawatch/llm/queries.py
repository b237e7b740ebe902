"""The queries of this subpackage, each over the whole of its tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, fingerprints, jaccard, langid, packing, quality, sharding, substrings, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.histogram_sort(_documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.divergence_rules(_documents(spark, sf_dir))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = warc.restore(*warc.archive(warc.records(pages)))
    return out.withColumn("record", F.col("record").cast("string"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    """The ids of every document, and whether they decode to its text (by its hash)."""
    docs = _documents(spark, sf_dir).withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    done = bpe.decode(bpe.encode(docs, vocabulary, ("doc_id", "mark")), vocabulary, ("doc_id", "mark", "ids"))
    return done.select("doc_id", "ids", (F.xxhash64("text") == F.col("mark")).alias("exact"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))


def op9_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs that masking digits changes, found from the sketches of both versions."""
    masked = F.regexp_replace("text", "[0-9]+", "0")
    return fingerprints.changed_paragraphs(_documents(spark, sf_dir), F.col("text"), masked)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and the number of its links."""
    return jaccard.similar_classes(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_histogram_sort, op2_best_fit_packing, op3_quality_divergence, op4_warc_archive, op5_quality_classifier, op6_language_id, op7_bpe, op8_substring_dedup, op9_iblt_fingerprints, op10_ngram_jaccard)
}

_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"

ORACLE_SQL: dict[str, str] = {
    "op1_histogram_sort": """
        WITH s AS (SELECT *, coalesce(strlen(text), 0)::HUGEINT AS b FROM documents),
        t AS (SELECT sum(b)::HUGEINT AS total, greatest(8, (sum(b) + 33554431) // 33554432)::HUGEINT AS n FROM s),
        c AS (SELECT s.*, total, n, sum(b) OVER (ORDER BY source, doc_id RANGE UNBOUNDED PRECEDING) - sum(b) OVER (PARTITION BY source, doc_id) AS below FROM s, t),
        p AS (SELECT *, least(n - 1, below::HUGEINT * n // total)::INT AS shard FROM c)
        SELECT doc_id, text, lang, source, n_chars, shard,
               (row_number() OVER (PARTITION BY shard ORDER BY source, doc_id, text) - 1)::INT AS pos FROM p""",
    "op3_quality_divergence": rf"""
        WITH chars AS (
            SELECT doc_id, lang, unnest([0, 1, 2, 3, 4, 5, 6]) AS k, unnest([
                length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')),
                length(regexp_replace(text, '[^0-9]', '', 'g')), length(regexp_replace(text, '[^\t\n\x0b\x0c\r ]', '', 'g')),
                length(regexp_replace(text, '[^.,;:!?''"()\-]', '', 'g')),
                length(regexp_replace(text, '[a-zA-Z0-9\t\n\x0b\x0c\r .,;:!?''"()\-\x{{80}}-\x{{10FFFF}}]', '', 'g')),
                length(regexp_replace(text, '[\x00-\x7f]', '', 'g'))]) AS n FROM documents),
        cref AS (SELECT lang, k, sum(n) AS n FROM chars GROUP BY ALL),
        cp AS (SELECT doc_id, k, n / greatest(sum(n) OVER (PARTITION BY doc_id), 1) AS p, sum(n) OVER (PARTITION BY doc_id) AS size, c.lang FROM chars c),
        cq AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM cref),
        cjs AS (SELECT doc_id, any_value(size) AS size, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d
                FROM cp JOIN cq USING (lang, k) GROUP BY doc_id),
        w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS word FROM documents),
        wn AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
        top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM wn QUALIFY k <= 64),
        bins AS (SELECT lang, k, n FROM top UNION ALL
                 SELECT lang, 65, sum(n) - (SELECT sum(n) FROM top t WHERE t.lang = wn.lang) FROM wn GROUP BY lang),
        wq AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM bins),
        wd AS (SELECT doc_id, coalesce(k, 65) AS k, count(*) AS n FROM w LEFT JOIN top USING (lang, word) GROUP BY ALL),
        size AS (SELECT doc_id, sum(n) AS size FROM wd GROUP BY doc_id),
        wp AS (SELECT d.doc_id, wq.k, q, coalesce(n, 0) / size AS p, size FROM documents d JOIN size USING (doc_id) JOIN wq USING (lang) LEFT JOIN wd ON wd.doc_id = d.doc_id AND wd.k = wq.k),
        wjs AS (SELECT doc_id, any_value(size) AS size, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d FROM wp GROUP BY doc_id),
        j AS (SELECT doc_id, CASE WHEN c.size >= 200 THEN round(sqrt(greatest(c.d, 0)), 6) ELSE 0 END AS char_js,
                     CASE WHEN wjs.size >= 50 THEN round(sqrt(greatest(wjs.d, 0)), 6) ELSE 0 END AS word_js FROM cjs c LEFT JOIN wjs USING (doc_id))
        SELECT doc_id, char_js, word_js, char_js <= 0.3 AND word_js <= 0.45 AS keep FROM j""",
    "op4_warc_archive": r"""
        SELECT page_id, sha256(html) AS digest, strlen(html)::BIGINT AS size,
               'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Target-URI: ' || url || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e
               || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(html) || e || e || html AS record
        FROM (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS e FROM pages)""",
    "op9_iblt_fingerprints": r"""
        WITH v AS (SELECT doc_id, text AS a, regexp_replace(text, '[0-9]+', '0', 'g') AS b FROM documents),
        a AS (SELECT DISTINCT doc_id, unnest(string_split(a, chr(10))) AS p FROM v),
        b AS (SELECT DISTINCT doc_id, unnest(string_split(b, chr(10))) AS p FROM v),
        d AS (SELECT doc_id, 'removed' AS side, p FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
              UNION ALL SELECT doc_id, 'added', p FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
        SELECT doc_id, side, ('0x' || substr(md5(p), 1, 15))::BIGINT AS digest FROM d WHERE p <> ''""",
    "op10_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS t FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.6),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, least(d.doc_id, coalesce(low, d.doc_id)) AS class_id, coalesce(links, 0)::BIGINT AS links FROM documents d
        LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) r ON r.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS links FROM e GROUP BY a) e ON e.a = d.doc_id""",
    "op8_substring_dedup": r"""
        WITH p AS (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS p FROM documents),
        w AS (SELECT doc_id, list_transform(p, lambda x: regexp_extract(x, '\S+')) AS w FROM p),
        i AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
        h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM i),
        r AS (SELECT doc_id, i FROM h QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM r),
        a AS (SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i FROM p),
        k AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS kept, count(*) AS n FROM a ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, regexp_extract(text, '^\s*') || coalesce(kept, '') AS text, (len(p) - coalesce(n, 0))::INT AS cut_words
        FROM documents d JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
