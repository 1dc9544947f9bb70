"""The driver's tables read as a catalogue of works, in Spark and as SQL text.

entity: parts.  entity_attr: a part's type (genre), brand (country) and the
words of its name (keyword).  crew: customers of a part, by return flag as role.
attr_value: labels and length of documents; a document without a row is unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import table

ENTITY_SQL = "entity AS (SELECT p_partkey AS entity, p_name AS title, 1916 + 2 * p_size AS year FROM part)"
ATTR_SQL = """entity_attr AS (
  SELECT p_partkey AS entity, 'genre' AS field, p_type AS value FROM part
  UNION ALL SELECT p_partkey, 'country', p_brand FROM part
  UNION ALL SELECT DISTINCT p_partkey, 'keyword', w FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE length(w) > 2)"""
CREW_SQL = """crew AS (
  SELECT DISTINCT l_partkey AS entity, l_returnflag AS role, o_custkey AS person FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
VALUE_SQL = """attr_value AS (
  SELECT doc_id AS entity, 'quality' AS attr, CAST(max(quality) AS DOUBLE) AS value FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
  UNION ALL SELECT doc_id, 'toxic', CAST(max(toxic) AS DOUBLE) FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id
  UNION ALL SELECT doc_id, 'long', floor(least(1.0, n_chars / 8000.0) * 100) / 100 FROM documents WHERE lang IN ('en', 'fr')
  UNION ALL SELECT doc_id, 'terse', floor((1.0 - least(1.0, n_chars / 2000.0)) * 100) / 100 FROM documents WHERE lang <> 'de')"""


def entity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("title"), (1916 + 2 * F.col("p_size")).alias("year"))


def entity_attr(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    words = F.array_distinct(F.filter(F.split(F.lower("p_name"), " "), lambda w: F.length(w) > 2))
    rows = F.concat(F.array(F.struct(F.lit("genre").alias("field"), F.col("p_type").alias("value")), F.struct(F.lit("country").alias("field"), F.col("p_brand").alias("value"))), F.transform(words, lambda w: F.struct(F.lit("keyword").alias("field"), w.alias("value"))))
    return part.select(F.col("p_partkey").alias("entity"), F.inline(rows))


def crew(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("role"), F.col("o_custkey").alias("person")).distinct()


def attr_value(spark: SparkSession, sf: str) -> DataFrame:
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    one = lambda c: labels.where(F.col(c).isNotNull()).groupBy(F.col("doc_id").alias("entity")).agg(F.lit(c).alias("attr"), F.max(c).cast("double").alias("value"))
    long = docs.where(F.col("lang").isin("en", "fr")).select(F.col("doc_id").alias("entity"), F.lit("long").alias("attr"), (F.floor(F.least(F.lit(1.0), F.col("n_chars") / 8000.0) * 100) / 100).alias("value"))
    terse = docs.where(F.col("lang") != "de").select(F.col("doc_id").alias("entity"), F.lit("terse").alias("attr"), (F.floor((1.0 - F.least(F.lit(1.0), F.col("n_chars") / 2000.0)) * 100) / 100).alias("value"))
    return one("quality").unionByName(one("toxic")).unionByName(long).unionByName(terse)


def documents_universe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("entity")).distinct()
