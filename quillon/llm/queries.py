"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import remainder
from quillon.llm.decontaminate import contained_items
from quillon.llm.html_text import extract_main_text
from quillon.llm.licenses import scan_licenses
from quillon.llm.lm_scoring import score_texts
from quillon.llm.mixing import MAX_TRAIN, mix
from quillon.llm.ngram_join import near_duplicate_groups
from quillon.llm.quality import fit_quality, score_quality
from quillon.llm.topk import top_inner_products
from quillon.llm.url_filters import judge_urls
from quillon.llm.warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f):
    QUERIES[f.__name__] = f
    return f


TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def labelled_languages(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """The labelled table of the mixing query: texts of at most ``most`` ids of ``labels``, with their language as domain."""
    ids = labels.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most).select("doc_id")
    return docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text", F.col("lang").alias("domain"))


def document_path() -> Column:
    """Where a document stands in the tree that its query scans: source, language, thousand of its id."""
    part = lambda c: F.coalesce(F.col(c), F.lit("none"))
    return F.concat_ws("/", part("source"), part("lang"), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document: its own notice, or that of the nearest directory above it."""
    files = _table(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), "text")
    return scan_licenses(files).withColumnRenamed("id", "doc_id")


@_query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document's whole text under the backoff automaton."""
    return score_texts(_table(spark, sf_dir, "documents"))


@_query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the share of its shingles."""
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for each query row of the embeddings."""
    return top_inner_products(_table(spark, sf_dir, "embeddings"))


@_query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge_urls(_table(spark, sf_dir, "pages"))


@_query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rate and copies of every document."""
    docs = _table(spark, sf_dir, "documents")
    mixed = mix(docs, labelled_languages(docs, _table(spark, sf_dir, "labels")), TARGETS)
    return mixed.select("doc_id", "n_tokens", *(F.coalesce(F.col("domains")[d], F.lit(0.0)).alias(f"p_{d}") for d in sorted(TARGETS)), "rate", "copies")


@_query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


@_query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@_query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return near_duplicate_groups(_table(spark, sf_dir, "documents"))


@_query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What archives of all pages say of each page."""
    return archive_round_trip(_table(spark, sf_dir, "pages"))


_LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words_sql(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all({_LOWER.format(c='text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table}"


def _shingles_sql(words: str, key: str, size: int) -> str:
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {size} THEN list_transform(range(1, len(w) - {size - 2}), lambda i: {run}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM {words}"


ORACLES["op3_benchmark_decontamination"] = f"""WITH dw AS ({_words_sql('documents', 'doc_id')}), iw AS ({_words_sql('benchmark', 'item_id')}),
d AS ({_shingles_sql('dw', 'doc_id', 5)}), q AS ({_shingles_sql('iw', 'item_id', 5)}), n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_common, n_item, count(*) / n_item AS containment FROM d JOIN q USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= 80 * n_item"""

ORACLES["op4_exact_top_k"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""

ORACLES["op9_ngram_jaccard_join"] = f"""WITH RECURSIVE w AS ({_words_sql('documents', 'doc_id')}), s AS ({_shingles_sql('w', 'doc_id', 4)}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)), e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id), m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_BASE32 = " || ".join(f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substring(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31 AS BIGINT) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
ORACLES["op10_warc"] = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT html, max(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f ON p.html = f.html"""
