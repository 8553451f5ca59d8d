"""Registered queries of this folder: each applies one operator to its whole table.

`QUERIES` maps names to functions of (spark, folder); `ORACLE` has the SQL where SQL can say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfspark.llm import (
    decontam,
    exact,
    importance,
    langid,
    lines,
    minhash,
    packing,
    periodic,
    suffix,
    toxicity,
    warc,
    whitening,
    wrapper,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents")).drop("row")


@_query(
    "op2_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
               FROM pages),
         q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
    FROM q
    """,
)
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    back = warc.round_trip(table(spark, folder, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@_query("op5_language_id")
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_of(table(spark, folder, "documents"))


@_query(
    "op6_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
         g AS (SELECT *, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
               FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
    """,
)
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


@_query(
    "op7_suffix_array_dedup",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
         starts AS (SELECT doc_id, unnest(range(length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100),
         strings AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM starts JOIN d USING (doc_id)),
         seen AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM strings),
         gone AS (SELECT doc_id, p, p - lag(p) OVER w AS step FROM seen WHERE first < doc_id
                  WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
         numbered AS (SELECT *, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS n
                      FROM gone),
         spans AS (SELECT doc_id, n, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, n),
         gaps AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM spans),
         kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
                         string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a) AS head
                  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(head || substr(h, CAST(2 * last + 1 AS BIGINT)), h))) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.repeated_strings(table(spark, folder, "documents"))


@_query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.line_duplicates(table(spark, folder, "documents"), degrees=False)
    return found.select("doc_id", "n_lines", "n_removed", "n_alike", F.sha2("text", 256).alias("kept_sha256"))


@_query("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query("op10_importance_resampling")
def op10_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query(
    "op11_html_extraction",
    r"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
         plain AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(h1|p|br)>', ' ', 'g'), '<[^>]+>', '', 'g') AS t FROM a),
         decoded AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'),
                            '&lt;', '<'), '&gt;', '>') AS t FROM plain),
         clean AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM decoded)
    SELECT page_id, url, text, length(text) AS n_chars FROM clean
    """,
)
def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.main_text(table(spark, folder, "pages"))


@_query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


@_query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", repeating("doc_id", "text").alias("text"))
    return run_digests(periodic.periodic_runs(docs))


def repeating(doc_id: str, text: str) -> F.Column:
    """The text to search: of every tenth document by the hash of its id, a tail is overwritten by a repetition."""
    h = F.crc32(F.col(doc_id).cast("string"))
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, g = F.greatest(F.size(words), F.lit(1)), F.floor(h / 10)
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    times = F.ceil((n - start) / period).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, start + 1, period), times))
    moved = F.slice(F.concat(F.slice(words, F.lit(1), start), tail), F.lit(1), F.size(words))
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.array_join(moved, " ")).otherwise(F.col(text))


def run_digests(found: DataFrame) -> DataFrame:
    """Runs as one row of numbers and digests per document."""
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    )
    lines_of = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines_of, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), "runs", "collapsed").select(
        "doc_id",
        "n_runs",
        F.col("top.start").alias("start"),
        (-F.col("top.less")).alias("length"),
        F.col("top.period").alias("period"),
        F.floor(-1000 * F.col("top.less") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
