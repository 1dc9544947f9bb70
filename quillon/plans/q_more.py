"""Round trips of readers and writers, and the secondary programs."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import stats as st
from quillon.functions import text as tx
from quillon.operators import audit as au
from quillon.operators import graph as g
from quillon.operators import retrieve as r
from quillon.operators import validate as va
from quillon.plans import analogue as an
from quillon.plans.q_retrieve import SIM_SQL, _sims
from quillon.plans.registry import query, table
from quillon.sources import readers as rd


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/quillon-scratch/{name}-{uuid.uuid4().hex}"


@query("json_round_trip", "S01 S02 S03", "SELECT p_partkey, p_name, p_size FROM part")
def json_round_trip(spark, sf):
    path = scratch(spark, "json")
    rd.write_atomically(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path)
    return spark.read.schema("p_partkey bigint, p_name string, p_size int").json(path)


@query("vector_round_trip", "S19", "SELECT CAST(label AS VARCHAR) AS entity, CAST(vec_id AS INT) AS chunk_no, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def vector_round_trip(spark, sf):
    path = scratch(spark, "vectors")
    rd.write_vectors(table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("entity"), F.col("vec_id").cast("int").alias("chunk_no"), F.col("embedding").alias("vector")), path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rd.read_vectors(spark, path).select("entity", "chunk_no", F.round(total, 5).alias("total"))


@query("cohort_round_trip", "S06", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def cohort_round_trip(spark, sf):
    path, s = scratch(spark, "cohort"), table(spark, sf, "supplier")
    rd.write_cohort(s.where("s_suppkey % 3 = 0"), "s_suppkey", path)
    return s.join(rd.read_cohort(spark, path), s["s_suppkey"].cast("string") == F.col("key"), "left_semi").select("s_suppkey")


@query("tensor_file", "S20")
def tensor_file(spark, sf):
    """Shapes of a tensor file that is written and parsed in memory."""
    data = np.arange(6, dtype="<f4").tobytes()
    head = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, len(data)]}, "__metadata__": {}}).encode()
    got = rd.parse_safetensors(len(head).to_bytes(8, "little") + head + data)
    return spark.createDataFrame([(k, shape, float(np.frombuffer(raw, "<f4").sum())) for k, (shape, raw) in got.items()], "name string, shape array<int>, total double")


@query("page_artifact", "S26")
def page_artifact(spark, sf):
    page = rd.html_artifact("<html><!--data--></html>", {"data": json.dumps({"n": table(spark, sf, "region").count()})})
    return spark.createDataFrame([(page,)], "page string")


@query("gated_read", "S28")
def gated_read(spark, sf):
    """A table whose gate passed is read; one whose gate failed is refused."""
    ok, bad, data = scratch(spark, "gate"), scratch(spark, "gate"), scratch(spark, "plots")
    table(spark, sf, "region").select("r_regionkey").write.json(data)
    spark.range(1).select(F.lit(True).alias("passed")).write.json(ok)
    spark.range(1).select(F.lit(False).alias("passed")).write.json(bad)
    n = rd.read_passages(spark, data, ok, "r_regionkey int").count()
    try:
        rd.read_passages(spark, data, bad, "r_regionkey int")
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(n, refused)], "n bigint, refused boolean")


@query("remote_pages", "S08 S12 S16 S18")
def remote_pages(spark, sf):
    """The paged source over a stand-in for a remote API that fails once a page."""
    failed: set[int] = set()

    def fetch(page: int):
        if page not in failed:
            failed.add(page)
            raise OSError("busy")
        return [(f"Q{page * 10 + i}", f"label {i}") for i in range(10)]

    spark.dataSource.register(rd.paged_source("quillon_demo_pages", fetch))
    return spark.read.format("quillon_demo_pages").option("pages", "5").option("pages_per_task", "2").load()


@query("length_batches", "K08", "WITH x AS (SELECT doc_id, coalesce(length(text), 0) AS n, floor((row_number() OVER (ORDER BY coalesce(length(text), 0), doc_id) - 1) / 32) AS batch FROM documents) SELECT doc_id, CAST(n AS INT) AS n, CAST(batch AS BIGINT) AS batch, CAST(max(n) OVER (PARTITION BY batch) AS INT) AS padded FROM x")
def length_batches(spark, sf):
    """Texts in batches of 32 of like length."""
    return r.length_batches(table(spark, sf, "documents"), "doc_id", "text", 32)


@query("json_documents", "S01", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_documents(spark, sf):
    """A JSON document a file."""
    path = scratch(spark, "documents")
    table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey", F.col("n_nationkey").alias("part")).write.partitionBy("part").json(path)
    return rd.read_json_document(spark, path, "n_nationkey bigint, n_name string, n_regionkey bigint").select("n_nationkey", "n_name", "n_regionkey")


@query("json_map", "S01", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation")
def json_map(spark, sf):
    """A file that holds one map."""
    path, n = scratch(spark, "map"), table(spark, sf, "nation")
    whole = n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))).alias("value"))  # the map of nations is one small document
    whole.write.text(path)
    return rd.read_json_map(spark, path, "string")


@query("json_shards", "S27 X02", "SELECT n_regionkey AS region, count(*) AS good, 1 AS bad FROM nation GROUP BY 1")
def json_shards(spark, sf):
    """Shards of which one in each folder can't be read: it is skipped and counted."""
    path, n = scratch(spark, "shards"), table(spark, sf, "nation")
    n.select("n_nationkey", F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("part")).write.partitionBy("region", "part").json(path)
    n.select(F.col("n_regionkey").alias("region"), F.lit(-1).alias("part"), F.lit('{"n_nationkey": 1').alias("value")).distinct().write.mode("append").partitionBy("region", "part").text(path)
    read = rd.read_shards(spark, path, "n_nationkey bigint")
    return read.groupBy(F.col("region").cast("bigint").alias("region")).agg(F.count_if(F.col("n_nationkey").isNotNull() & F.col("_corrupt").isNull()).alias("good"), F.count_if(F.col("_corrupt").isNotNull()).cast("int").alias("bad"))


@query("seed_file", "S04", "SELECT p_name AS title, 1916 + 2 * p_size AS year, count(*) AS n FROM part GROUP BY ALL")
def seed_file(spark, sf):
    """Seed lines from a file with comments and blank lines."""
    path = scratch(spark, "seeds")
    line = F.concat("p_name", F.lit(" ("), (1916 + 2 * F.col("p_size")).cast("string"), F.lit(")"))
    table(spark, sf, "part").select(F.explode(F.array(line, F.concat(F.lit("# "), line), F.lit(""))).alias("value")).write.text(path)
    return rd.read_seeds(spark, path).groupBy("title", "year").agg(F.count("*").alias("n"))


@query("ratings_file", "S07 S05 A17 J20", "WITH v AS (SELECT l_partkey AS p, count(*) AS v, round(avg(l_quantity), 4) AS r FROM lineitem GROUP BY l_partkey), c AS (SELECT avg(r) AS c FROM v) SELECT p_name, p, round(v / (v + 30.0) * r + 30.0 / (v + 30.0) * c, 2) AS score FROM v CROSS JOIN c JOIN part ON p_partkey = p")
def ratings_file(spark, sf):
    """Ratings from a gzip file of tab-separated values, joined to works by id."""
    path = scratch(spark, "ratings")
    rated = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 4).alias("r"), F.count("*").alias("v"))
    rated.select(F.concat(F.lit("tt"), F.col("l_partkey").cast("string")), "r", "v").write.option("sep", "\t").option("compression", "gzip").csv(path)
    v = rd.read_tsv(spark, path, "id string, r double, v bigint")
    works = table(spark, sf, "part").select("p_name", F.col("p_partkey").alias("p"), F.concat(F.lit("tt"), F.col("p_partkey").cast("string")).alias("id"))
    joined = v.join(works, "id").join(F.broadcast(v.agg(F.avg("r").alias("c"))))
    return joined.select("p_name", "p", r.weighted_rating(F.col("v"), F.col("r"), F.col("c"), 30.0).alias("score"))


@query("title_leak", "Q21", "SELECT p_type, round(avg(CASE WHEN contains(p_name, 'ring') THEN 1.0 ELSE 0 END), 6) AS leak, round(avg(CASE WHEN p_size < 5 THEN 1.0 ELSE 0 END), 6) AS thin FROM part GROUP BY p_type")
def title_leak(spark, sf):
    """Share of works whose title gives the query's word away, and share of thin ones."""
    hit = F.size(F.array_intersect(F.split(tx.fold(F.col("p_name")), " "), F.array(F.lit("ring")))) > 0
    return table(spark, sf, "part").groupBy("p_type").agg(F.round(F.avg(hit.cast("int")), 6).alias("leak"), F.round(F.avg((F.col("p_size") < 5).cast("int")), 6).alias("thin"))


@query("fingerprint_similarity", "Q22", f"""WITH {an.ATTR_SQL}, tot AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM part), freq AS (SELECT value, count(DISTINCT entity) AS n FROM entity_attr WHERE field = 'keyword' GROUP BY value), av AS (SELECT entity, value, least(1.0, ln(total / n) / ln(total)) AS idf FROM entity_attr JOIN freq USING (value) CROSS JOIN tot WHERE field = 'keyword' AND n <= 0.15 * total),
own AS (SELECT entity, sum(idf) AS w FROM av GROUP BY entity), p AS (SELECT x.entity AS a, y.entity AS b, sum(x.idf) AS c FROM av x JOIN av y ON x.value = y.value AND x.entity < y.entity GROUP BY 1, 2),
s AS (SELECT a, round(least(1.0, (0.55 * (1 - abs(i.p_size - j.p_size) / 50.0) + 0.45 * c / (u.w + v.w - c)) * CASE WHEN i.p_type <> j.p_type THEN 1.15 ELSE 1 END), 6) AS sim FROM p JOIN own u ON u.entity = a JOIN own v ON v.entity = b JOIN part i ON i.p_partkey = a JOIN part j ON j.p_partkey = b)
SELECT a, count(*) AS n, max(sim) AS best FROM s WHERE sim >= 0.72 GROUP BY a""")
def fingerprint_similarity(spark, sf):
    """.55 axis similarity + .45 idf-weighted overlap, x 1.15 across clusters, from .72; values of over 15 % of works don't count."""
    n = an.entity(spark, sf).count()
    attrs = g.with_idf(an.entity_attr(spark, sf).where("field = 'keyword'"), n).where(F.col("n") <= 0.15 * n)
    axes = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_size").alias("s"), F.col("p_type").alias("t"))
    return g.fingerprint_alike(attrs, axes)


@query("composed_score", "Q23", f"WITH {SIM_SQL} SELECT query // 200 AS pair, chunk, round(power(product(greatest(sim, 0)), 1.0 / count(*)), 6) AS score FROM sim GROUP BY ALL")
def composed_score(spark, sf):
    """Likeness of every chunk to two chosen works at once: the stated queries two by two."""
    s = _sims(spark, sf).withColumn("pair", F.expr("query div 200"))
    return r.composed(s, "chunk").select("pair", "chunk", F.round("score", 6).alias("score"))


@query("authored_edges", "Z01", "SELECT count(*) AS n FROM (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_returnflag FROM lineitem)")
def authored_edges(spark, sf):
    """Authored edges keep one line for each pair and type, the first by order."""
    x = table(spark, sf, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), F.col("l_returnflag").alias("type"), F.struct("l_orderkey", "l_linenumber").alias("o"))
    return x.groupBy("a", "b", "type").agg(F.min("o").alias("o")).agg(F.count("*").alias("n"))


@query("first_spine", "Z02 Z03 J03 J04", f"WITH {an.CREW_SQL}, p AS (SELECT DISTINCT x.entity AS a, y.entity AS b FROM crew x JOIN crew y ON x.role = y.role AND x.person = y.person AND x.entity < y.entity), d AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem JOIN part ON p_partkey = l_suppkey WHERE l_suppkey <> l_partkey) SELECT 'crew' AS signal, count(*) AS n FROM p UNION ALL SELECT 'descent', count(*) FROM d")
def first_spine(spark, sf):
    """The first generation of the graph: crew and descent edges alone."""
    refs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("source")).distinct()
    crew = g.crew_proposals(an.crew(spark, sf), {"A": 0.62, "N": 0.58, "R": 0.46}).select(F.lit("crew").alias("signal"))
    return crew.unionByName(g.reference_proposals(refs, an.entity(spark, sf)).select(F.lit("descent").alias("signal"))).groupBy("signal").agg(F.count("*").alias("n"))


@query("stripper_check", "Z07 T11")
def stripper_check(spark, sf):
    """Characters of every page's text by two independent strippers."""
    return tx.stripper_lengths(table(spark, sf, "pages"), "page_id", "html").withColumn("differ", ~F.col("a").eqNullSafe(F.col("b")))


@query("fame_blocks", "Z08 M01", """WITH v AS (SELECT n_regionkey AS block, c_acctbal AS x, count(o_orderkey) AS y FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, n_regionkey, c_acctbal),
r AS (SELECT block, rank() OVER (PARTITION BY block ORDER BY x) + (count(*) OVER (PARTITION BY block, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY block ORDER BY y) + (count(*) OVER (PARTITION BY block, y) - 1) / 2.0 AS ry FROM v) SELECT block, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY block""")
def fame_blocks(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    v = c.groupBy("c_custkey", F.col("n_regionkey").alias("block"), F.col("c_acctbal").alias("x")).agg(F.count("*").alias("y"))
    return st.spearman(v, "x", "y", ["block"]).select("block", F.round("rho", 6).alias("rho"), "n")


@query("attribute_dump", "Z19", f"WITH {an.ATTR_SQL} SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY value) AS ordinal FROM (SELECT DISTINCT field, value FROM entity_attr)")
def attribute_dump(spark, sf):
    """Attributes with an explicit ordinal, so that no reader depends on a collation."""
    return an.entity_attr(spark, sf).select("field", "value").distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy("field").orderBy("value")))


@query("focused_texts", "Z25", "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 4 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rn FROM c WHERE n >= 20) SELECT doc_id, word, n FROM r WHERE rn = 1")
def focused_texts(spark, sf):
    """Texts that come back to one word often enough."""
    return tx.focus(table(spark, sf, "documents"), "doc_id", "text")


@query("notes", "Z28", "SELECT conv_id, turn, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1 AND turn % 5 <> 4")
def notes(spark, sf) -> DataFrame:
    """Conversations as notes that each turn rewrites, and every fifth deletes."""
    log = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.when(F.col("turn") % 5 == 4, "delete").otherwise("set").alias("op"))
    return va.apply_changes(log, "conv_id", "turn")


@query("side_by_side", "Z23 A45", "SELECT round(count(*) / 10.0, 6) AS overlap FROM (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10) JOIN (SELECT s_suppkey FROM supplier ORDER BY s_nationkey, s_suppkey LIMIT 10) USING (s_suppkey)")
def side_by_side(spark, sf):
    s = table(spark, sf, "supplier").withColumn("query", F.lit(0))
    a = r.rank_of(s.withColumn("score", F.col("s_acctbal")), "s_suppkey").where("rank <= 10")
    b = r.rank_of(s.withColumn("score", -F.col("s_nationkey").cast("double")), "s_suppkey").where("rank <= 10")
    assert au.decoy_verdict(0.9, 0.5) == "void"
    return a.join(b.select("s_suppkey"), "s_suppkey").agg(F.round(F.count("*") / 10, 6).alias("overlap"))
