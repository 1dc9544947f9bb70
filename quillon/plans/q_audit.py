"""Validation and audit queries: tags are documents' sources and languages, edges are order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import audit as au
from quillon.operators import graph as g
from quillon.operators import validate as va
from quillon.plans import analogue as an
from quillon.plans.registry import query, shared_checkpoints, table
from quillon.sources import readers as rd

TAG_SQL = "tags AS (SELECT doc_id AS entity, source AS predicate, CASE lang WHEN 'en' THEN 'lead' WHEN 'fr' THEN 'side' ELSE 'odd' END AS role, round(least(1.0, n_chars / 4000.0), 2) AS centrality, CASE doc_id % 3 WHEN 0 THEN 'won' WHEN 1 THEN 'lost' ELSE 'open' END AS outcome, substring(text, 1, CAST(doc_id % 40 AS INT)) AS basis, doc_id AS ordinal FROM documents)"


def _tags(spark, sf):
    d = table(spark, sf, "documents")
    role = F.when(F.col("lang") == "en", "lead").when(F.col("lang") == "fr", "side").otherwise("odd")
    outcome = F.when(F.col("doc_id") % 3 == 0, "won").when(F.col("doc_id") % 3 == 1, "lost").otherwise("open")
    return d.select(F.col("doc_id").alias("entity"), F.col("source").alias("predicate"), role.alias("role"), F.round(F.least(F.lit(1.0), F.col("n_chars") / 4000.0), 2).alias("centrality"), outcome.alias("outcome"), F.substring("text", F.lit(1), (F.col("doc_id") % 40).cast("int")).alias("basis"), F.col("doc_id").alias("ordinal"))


RULES = (["lead", "side"], ["won", "lost", "open"], [f"src{i}" for i in range(15)])


@query("tag_rejections", "F06", f"WITH {TAG_SQL} SELECT coalesce(CASE WHEN predicate NOT IN ({', '.join(repr(x) for x in RULES[2])}) THEN 'unknown predicate' WHEN role = 'odd' THEN 'unknown role' WHEN centrality <= 0 THEN 'centrality out of range' WHEN length(basis) < 20 THEN 'basis too short' END, 'accepted') AS reason, count(*) AS n FROM tags GROUP BY 1")
def tag_rejections(spark, sf):
    return va.validate_tags(_tags(spark, sf), *RULES).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("merged_tags", "F07", f"WITH {TAG_SQL}, a AS (SELECT * FROM tags WHERE predicate IN ({', '.join(repr(x) for x in RULES[2])}) AND role <> 'odd' AND centrality > 0 AND length(basis) >= 20) SELECT predicate, count(*) AS n FROM a GROUP BY predicate")
def merged_tags(spark, sf):
    """Two overlapping shards: each accepted tag once."""
    t = _tags(spark, sf)
    return va.merge_tags([t.where("entity % 3 < 2"), t.where("entity % 3 > 0")], *RULES).groupBy("predicate").agg(F.count("*").alias("n"))


@query("normalised_replies", "F08 S27", "SELECT doc_id, CASE WHEN quality > 0 THEN 1 ELSE 0 END AS n, CASE WHEN doc_id % 2 = 0 THEN 'thin' ELSE 'known' END AS tier FROM labels")
def normalised_replies(spark, sf):
    attrs = F.create_map(F.lit("quality"), F.col("quality") * 2.0, F.lit("made-up"), F.lit(1.0))
    recall = F.when(F.col("doc_id") % 2 == 0, "short").otherwise("a recall that is long enough")
    clean, tier = va.normalise_reply(attrs, recall, F.lit("known"), ["quality"])
    return table(spark, sf, "labels").select("doc_id", F.size(clean).alias("n"), tier.alias("tier"))


@query("normalised_axes", "F09", "SELECT o_orderkey, CAST(greatest(0, least(100, floor(o_totalprice / 3000.0 - 20 + 0.5))) AS INT) AS score FROM orders")
def normalised_axes(spark, sf):
    x = va.normalise_axis((F.col("o_totalprice") / 3000.0 - 20).cast("string"), F.lit("x"))
    return table(spark, sf, "orders").select("o_orderkey", x["score"].alias("score"))


@query("usable_values", "F02 F03", "SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') AND lower(p_name) NOT IN ('red ring') AND NOT regexp_matches(lower(p_name), 'small|tiny')")
def usable_values(spark, sf):
    ok = va.usable(F.col("p_brand"), F.col("p_name"), stop=["Brand#1", "Brand#2"], vacuous=["red ring"], vague="small|tiny")
    return table(spark, sf, "part").where(ok & ~va.shows_raw_id(F.col("p_name"))).select("p_partkey")


@query("evidence_floor", "F04", "SELECT lang, count(*) AS n FROM documents WHERE length(text) >= 1500 GROUP BY lang")
def evidence_floor(spark, sf):
    return table(spark, sf, "documents").where(va.enough_evidence(F.col("text"))).groupBy("lang").agg(F.count("*").alias("n"))


@query("edge_checks", "F12 F13", """WITH e AS (SELECT l_partkey AS a, l_suppkey AS b, l_quantity / 50.0 AS strength, CASE WHEN l_returnflag = 'A' THEN 'hand' ELSE 'odd' END AS type, CASE WHEN l_returnflag = 'N' THEN 'reading' ELSE 'record' END AS source, 'line of order ' || l_orderkey AS claim, least(l_partkey, l_suppkey) || '|' || greatest(l_partkey, l_suppkey) AS pair FROM lineitem)
SELECT rule, count(*) AS n FROM (SELECT 'endpoint' AS rule FROM e WHERE a NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) OR b NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) UNION ALL SELECT 'self edge' FROM e WHERE a = b UNION ALL SELECT 'type' FROM e WHERE type = 'odd' UNION ALL SELECT 'confidence' FROM e WHERE source = 'reading' UNION ALL SELECT 'evidence' FROM e WHERE source = 'record' UNION ALL SELECT 'two edges' FROM (SELECT pair FROM e GROUP BY pair HAVING count(*) > 1)) GROUP BY rule""")
def edge_checks(spark, sf):
    flag = F.col("l_returnflag")
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_quantity") / 50.0).alias("strength"), F.when(flag == "A", "hand").otherwise("odd").alias("type"), F.when(flag == "N", "reading").otherwise("record").alias("source"), F.concat(F.lit("line of order "), F.col("l_orderkey").cast("string")).alias("claim"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("evidence"))
    return va.edge_violations(e, an.entity(spark, sf).where("entity % 10 <> 0")).groupBy("rule").agg(F.count("*").alias("n"))


@query("trivia_shares", "F14 A20", "SELECT l_shipmode_like AS signal, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM lineitem), 6) AS share, l_shipmode_like IN ('genre', 'cast') AS trivia FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'genre' WHEN 'N' THEN 'crew' ELSE 'cast' END AS l_shipmode_like FROM lineitem) GROUP BY 1")
def trivia_shares(spark, sf):
    s = F.when(F.col("l_returnflag") == "A", "genre").when(F.col("l_returnflag") == "N", "crew").otherwise("cast")
    x = au.signal_shares(table(spark, sf, "lineitem").withColumn("signal", s))
    return x.select("signal", "n", F.round("share", 6).alias("share"), va.is_trivia(F.col("signal")).alias("trivia"))


@query("stripped_alternates", "F15 G03", "SELECT l_orderkey, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS n FROM lineitem GROUP BY l_orderkey")
def stripped_alternates(spark, sf):
    s = F.when(F.col("l_returnflag") == "A", "genre").when(F.col("l_returnflag") == "N", "crew").otherwise("cast")
    also = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(s.alias("signal"))).alias("also"))
    return also.select("l_orderkey", F.size(va.strip_trivia(F.col("also"))).alias("n"))


@query("tonal_guard", "F16")
def tonal_guard(spark, sf):
    """The guard passes a table without tonal columns and refuses one with them."""
    ok, refused = True, False
    va.assert_no_tonal_input(table(spark, sf, "part").columns)
    try:
        va.assert_no_tonal_input(["entity", "mood"])
    except ValueError:
        refused = True
    return spark.createDataFrame([(ok, refused)], "passes boolean, refuses boolean")


@query("licence_and_shape", "F17", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'public domain|\\bpd\\b|cc0') THEN 'public' WHEN regexp_matches(lower(text), 'cc[- ]by') THEN 'cc' WHEN regexp_matches(lower(text), 'fair use|non-free') THEN 'fair' ELSE 'unknown' END AS licence, CASE WHEN n_chars * 1.0 / 2000 < 0.9 THEN 'portrait' WHEN n_chars * 1.0 / 2000 <= 1.1 THEN 'square' ELSE 'landscape' END AS shape FROM documents")
def licence_and_shape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", va.licence_of(F.col("text")).alias("licence"), va.shape_of(F.col("n_chars"), F.lit(2000)).alias("shape"))


@query("repeated_lines", "A20 A21", "SELECT CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS repeated, CAST(sum(n) AS BIGINT) AS all_lines, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS share FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)")
def repeated_lines(spark, sf):
    return au.repeated_lines(table(spark, sf, "part"), "p_name").select("repeated", F.col("all").alias("all_lines"), F.round("share", 6).alias("share"))


@query("map_diversity", "A21 A46", """WITH m AS (SELECT o_custkey AS seed, p_brand AS hand, 'Brand#' || (o_custkey % 25) AS seed_hand, p_type AS type, year(o_orderdate) AS year FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
t AS (SELECT seed, max(n) * 1.0 / sum(n) AS dominant, count(*) AS types FROM (SELECT seed, type, count(*) AS n FROM m GROUP BY ALL) GROUP BY seed), p AS (SELECT seed, avg(CASE WHEN hand = seed_hand THEN 1.0 ELSE 0 END) AS same, max(year) - min(year) AS span FROM m GROUP BY seed)
SELECT round(avg(same), 6) AS same_hand, round(avg(dominant), 6) AS dominant, round(avg(types), 6) AS types, round(avg(span), 6) AS span FROM p JOIN t USING (seed)""")
def map_diversity(spark, sf):
    m = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = au.map_diversity(m.select(F.col("o_custkey").alias("seed"), F.col("p_brand").alias("hand"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25).cast("string")).alias("seed_hand"), F.col("p_type").alias("type"), F.year("o_orderdate").alias("year")))
    return x.select(*(F.round(c, 6).alias(c) for c in ("same_hand", "dominant", "types", "span")))


@query("collapse_ratio", "A22", "SELECT round(max(n) * 1.0 / sum(n), 6) AS share FROM (SELECT round(l_discount, 2) AS s, count(*) AS n FROM lineitem GROUP BY 1)")
def collapse_ratio(spark, sf):
    return va.collapse_ratio(table(spark, sf, "lineitem").select(F.col("l_discount").alias("strength"))).select(F.round("share", 6).alias("share"))


@query("greedy_clusters", "A24")
def greedy_clusters(spark, sf):
    """Part names clustered around their most frequent leaders."""
    shared_checkpoints(spark)
    return au.leader_clusters(table(spark, sf, "part").groupBy(F.col("p_name").alias("phrase")).agg(F.count("*").alias("n")), 0.3)


SPARSE_SQL = "t AS (SELECT DISTINCT l_partkey AS entity, o_custkey AS predicate, l_partkey % 4 AS shard, 1916 + 2 * (l_partkey % 50) AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _sparse(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.select(F.col("l_partkey").alias("entity"), F.col("o_custkey").alias("predicate"), (F.col("l_partkey") % 4).alias("shard"), (1916 + 2 * (F.col("l_partkey") % 50)).alias("year")).distinct()


def _with_outcomes(t):
    return t.withColumn("centrality", ((F.col("entity") % 10) + 1) / 10).withColumn("outcome", F.when((F.col("entity") + F.col("predicate")) % 2 == 0, "won").otherwise("lost"))


@query("predicate_pairs", "J11 A30", f"WITH {SPARSE_SQL} SELECT x.predicate, count(*) AS pairs, count(CASE WHEN x.shard <> y.shard THEN 1 END) AS across FROM t x JOIN t y ON x.predicate = y.predicate AND x.entity < y.entity GROUP BY x.predicate")
def predicate_pairs(spark, sf):
    return au.pair_stats(_sparse(spark, sf), "shard").select("predicate", "pairs", "across")


@query("rebuttals", "A31", f"WITH {SPARSE_SQL} SELECT x.predicate, count(*) AS n FROM t x JOIN t y ON x.predicate = y.predicate AND x.entity < y.entity WHERE (x.entity + x.predicate) % 2 <> (y.entity + y.predicate) % 2 GROUP BY x.predicate")
def rebuttals(spark, sf):
    return au.rebuttals(_with_outcomes(_sparse(spark, sf)), [("won", "lost")]).groupBy("predicate").agg(F.count("*").alias("n"))


@query("family_scores", "A25 J11")
def family_scores(spark, sf):
    return au.score_predicate_pairs(_with_outcomes(_sparse(spark, sf)), an.entity(spark, sf).count(), [("won", "lost")]).where("k > 1")


@query("leverage", "A26 Z17", "WITH o AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem) SELECT min(CASE WHEN i = CAST(floor((n - 1) * 0.01) AS BIGINT) + 1 THEN v END) AS p01, min(CASE WHEN i = CAST(floor((n - 1) * 0.99) AS BIGINT) + 1 THEN v END) AS p99 FROM o")
def leverage(spark, sf):
    assert au.leverage_ok(0.6, 1.15)
    return au.realised_leverage(table(spark, sf, "lineitem"), "l_extendedprice").select("p01", "p99")


@query("prevalence", "A27 Z04 Z11", f"WITH {SPARSE_SQL} SELECT predicate, count(DISTINCT entity) AS n, round(count(DISTINCT entity) * 1.0 / (SELECT count(*) FROM part), 6) AS share, count(DISTINCT entity) * 1.0 / (SELECT count(*) FROM part) BETWEEN 0.004 AND 0.02 AS in_band FROM t GROUP BY predicate")
def prevalence(spark, sf):
    return au.prevalence(_sparse(spark, sf), an.entity(spark, sf).count(), high=0.02).select("predicate", "n", F.round("share", 6).alias("share"), "in_band")


FACTS_SQL = f"{SPARSE_SQL}, pr AS (SELECT DISTINCT x.entity AS a, y.entity AS b FROM t x JOIN t y ON x.predicate = y.predicate AND x.entity < y.entity), f AS (SELECT a, b, (a + b) % 3 = 0 AS edge FROM pr)"


@query("predicate_reach", "A28 A29", f"WITH {FACTS_SQL} SELECT x.predicate, count(*) AS pairs, CAST(sum(CASE WHEN edge THEN 0 ELSE 1 END) AS BIGINT) AS unreachable, round(avg(CASE WHEN edge THEN 0.0 ELSE 1.0 END) / (SELECT avg(CASE WHEN edge THEN 0.0 ELSE 1.0 END) FROM f), 6) AS lift FROM t x JOIN t y ON x.predicate = y.predicate AND x.entity < y.entity JOIN f ON f.a = x.entity AND f.b = y.entity GROUP BY x.predicate")
def predicate_reach(spark, sf):
    t = _with_outcomes(_sparse(spark, sf))
    pairs = au.predicate_pairs(t).select("a", "b").distinct()
    facts = au.pair_facts(pairs, edge=pairs.where("(a + b) % 3 = 0"))
    return au.predicate_reach(t, facts).select("predicate", "pairs", "unreachable", F.round("lift", 6).alias("lift"))


@query("joinability", "A33", f"WITH {SPARSE_SQL} SELECT (SELECT count(*) FROM (SELECT DISTINCT x.entity, y.entity AS e FROM t x JOIN t y ON x.predicate = y.predicate AND x.entity < y.entity)) AS lexical, (SELECT count(*) FROM (SELECT DISTINCT x.entity, y.entity AS e FROM t x JOIN t y ON x.predicate // 2 = y.predicate // 2 AND x.entity < y.entity)) AS clustered")
def joinability(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    t = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_partkey").alias("entity"), F.col("o_custkey").alias("phrase"))
    clusters = orders.select(F.col("o_custkey").alias("phrase")).distinct().withColumn("cluster", F.expr("phrase div 2"))
    return au.joinability(t, clusters, lines.count())


@query("held_out_agreement", "A34 A23 S05", "WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS x FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS y FROM lineitem WHERE l_linenumber > 3 GROUP BY 1), j AS (SELECT len(list_intersect(x, y)) * 1.0 / (len(x) + len(y) - len(list_intersect(x, y))) AS j FROM a JOIN b USING (k)) SELECT count(*) AS n, round(avg(j), 6) AS mean_jaccard, round(avg(CASE WHEN j = 1 THEN 1.0 ELSE 0 END), 6) AS exact FROM j")
def held_out_agreement(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag", "l_linenumber")
    a = au.set_agreement(x.where("l_linenumber <= 3"), x.where("l_linenumber > 3"), "k", "l_returnflag")
    return a.select("n", F.round("mean_jaccard", 6).alias("mean_jaccard"), F.round("exact", 6).alias("exact"))


@query("stability", "A35 Z13", "SELECT count(*) AS n, round(avg(CASE WHEN x = y THEN 1.0 ELSE 0 END), 6) AS exact, round(avg(CASE WHEN x <> 'NONE' AND y <> 'NONE' THEN CASE WHEN x = y THEN 1.0 ELSE 0 END END), 6) AS named, round(avg(CASE WHEN (x = 'NONE') <> (y = 'NONE') THEN 1.0 ELSE 0 END), 6) AS flips FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'NONE' ELSE o_orderstatus END AS x, CASE WHEN o_orderkey % 6 = 0 THEN 'NONE' WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS y FROM orders)")
def stability(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    a = o.select("o_orderkey", F.when(k % 4 == 0, "NONE").otherwise(F.col("o_orderstatus")).alias("label"))
    b = o.select("o_orderkey", F.when(k % 6 == 0, "NONE").when(k % 5 == 0, "F").otherwise(F.col("o_orderstatus")).alias("label"))
    return au.stability(a, b, "o_orderkey", "label").select("n", *(F.round(c, 6).alias(c) for c in ("exact", "named", "flips")))


@query("wishlist", "A36 J14", "SELECT p_name AS title, count(DISTINCT o_custkey) * greatest(1, count(DISTINCT l_returnflag)) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey < 5) GROUP BY p_name")
def wishlist(spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = x.select(F.col("p_name").alias("title"), F.col("o_custkey").alias("nominator"), F.col("l_returnflag").alias("reason"))
    return au.wishlist(n, table(spark, sf, "part").where("p_partkey < 5").select(F.col("p_name").alias("title")))


@query("predicate_coverage", "A37", f"WITH {SPARSE_SQL} SELECT predicate, count(DISTINCT entity) AS n, count(DISTINCT shard) AS regions, max(year) - min(year) AS span FROM t GROUP BY predicate HAVING n >= 6 AND regions >= 3 AND span >= 30")
def predicate_coverage(spark, sf):
    return au.predicate_coverage(_sparse(spark, sf).withColumnRenamed("shard", "region"))


@query("earliest_year", "A39", "SELECT o_custkey, min(year(o_orderdate)) AS year FROM orders GROUP BY o_custkey")
def earliest_year(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("year"))


@query("pole_prevalence", "A41", "SELECT l_returnflag AS axis, round(avg(CASE WHEN l_quantity * 2 <= 30 THEN 1.0 ELSE 0 END), 6) AS low, round(avg(CASE WHEN l_quantity * 2 >= 70 THEN 1.0 ELSE 0 END), 6) AS high FROM lineitem GROUP BY 1")
def pole_prevalence(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("axis"), (F.col("l_quantity") * 2).alias("score"))
    return au.pole_prevalence(s).select("axis", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("null_honesty", "A43", "SELECT p_type AS axis, count(CASE WHEN p_size > 10 AND p_size % 5 = 0 THEN 1 END) AS n FROM part GROUP BY 1")
def null_honesty(spark, sf):
    s = table(spark, sf, "part").select(F.col("p_type").alias("axis"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("score"), F.when(F.col("p_size") % 5 != 0, "why").otherwise("").alias("basis"))
    return au.null_honesty(s)


@query("coverage_by_group", "A44 Z09", "SELECT lang, count(*) AS n, count(quality) AS known, round(median(n_chars), 6) AS median_chars FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY lang")
def coverage_by_group(spark, sf):
    lab = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, sf, "documents").join(lab, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("known"), F.round(F.median("n_chars"), 6).alias("median_chars"))


@query("find_coverage", "A49", "WITH q AS (SELECT o_custkey AS query, list(DISTINCT o_orderkey) AS wanted FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), s AS (SELECT o_custkey AS query, list(DISTINCT o_orderkey) AS got FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1), j AS (SELECT len(list_intersect(wanted, coalesce(got, []))) AS f, len(wanted) AS w, coalesce(len(got), 0) AS g FROM q LEFT JOIN s USING (query)) SELECT count(CASE WHEN g > 0 THEN 1 END) AS answered, count(CASE WHEN f > 0 THEN 1 END) AS hit, count(CASE WHEN f >= ceil(w / 2) THEN 1 END) AS good, count(CASE WHEN g > 0 AND f = 0 THEN 1 END) AS worthless FROM j")
def find_coverage(spark, sf):
    o = table(spark, sf, "orders")
    q = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("query")).agg(F.collect_set("o_orderkey").alias("wanted"))
    s = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("entity"))
    return au.find_coverage(q, s)


@query("directional_share", "A52", "SELECT o_orderpriority AS type, round(count(CASE WHEN l_shipdate > o_orderdate AND l_returnflag <> 'R' THEN 1 END) * 1.0 / count(CASE WHEN l_returnflag <> 'R' THEN 1 END), 6) AS share FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def directional_share(spark, sf):
    e = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = au.directional_share(e.select(F.col("o_orderpriority").alias("type"), (F.col("l_returnflag") != "R").alias("directed"), F.col("o_orderdate").alias("from_year"), F.col("l_shipdate").alias("to_year")))
    return x.select("type", F.round("share", 6).alias("share"))


@query("neighbourhood_residual", "A53", "WITH e AS (SELECT DISTINCT l_partkey AS u, l_suppkey + 1000000 AS v FROM lineitem), m AS (SELECT u, avg(s_acctbal) AS m FROM e JOIN supplier ON s_suppkey + 1000000 = v GROUP BY u HAVING count(*) >= 3) SELECT p_partkey AS entity, round(p_retailprice - m + 0.00000123, 4) AS residual FROM part JOIN m ON u = p_partkey")
def neighbourhood_residual(spark, sf):
    """Parts' prices less their suppliers' mean balance; parts and suppliers are kept apart whatever their keys are."""
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v")).distinct()
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_retailprice").alias("value"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("value"))
    return au.neighbourhood_residual(e, parts, near_values=suppliers).select("entity", F.round(F.col("residual") + 0.00000123, 4).alias("residual"))


@query("discounted_score", "A55", "SELECT l_orderkey, round(sum(l_quantity / power(2, i)), 6) AS score FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) - 1 AS i FROM lineitem) GROUP BY l_orderkey")
def discounted_score(spark, sf):
    return au.discounted_score(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity").select("l_orderkey", F.round("score", 6).alias("score"))


@query("hub_share", "A56", "WITH d AS (SELECT l_suppkey AS entity, count(*) AS degree FROM lineitem GROUP BY 1) SELECT round((SELECT sum(degree) FROM (SELECT degree FROM d ORDER BY degree DESC, entity LIMIT 10)) / sum(degree), 6) AS share FROM d")
def hub_share(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(F.count("*").alias("degree"))
    return au.hub_share(d).select(F.round("share", 6).alias("share"))


@query("derangement", "J17", "WITH x AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT a.s_suppkey, b.s_suppkey AS other FROM x a JOIN x b ON b.i = (a.i + 1 + a.i % 7) % a.n")
def derangement(spark, sf):
    x = au.derangement(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey")
    return x.join(x.select(F.col("i").alias("j"), F.col("s_suppkey").alias("other")), "j").select("s_suppkey", "other")


@query("strangers", "J13", "SELECT count(*) AS n FROM (SELECT DISTINCT n_nationkey AS a, s_suppkey AS b FROM nation CROSS JOIN supplier) p ANTI JOIN (SELECT s_nationkey AS a, s_suppkey AS b FROM supplier) e ON p.a = e.a AND p.b = e.b")
def strangers(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey", F.col("s_suppkey").alias("b"))
    p = s.select("b", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("a"))
    return p.join(s.select(F.col("s_nationkey").alias("a"), "b"), ["a", "b"], "left_anti").agg(F.count("*").alias("n"))


@query("seat_allocation", "K11", "WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY 1), x AS (SELECT stratum, n * 37.0 / sum(n) OVER () AS e FROM s), y AS (SELECT stratum, floor(e) AS b, row_number() OVER (ORDER BY round(e - floor(e), 12) DESC, stratum) AS rn, 37 - sum(floor(e)) OVER () AS l FROM x) SELECT stratum, CAST(b + CASE WHEN rn <= l THEN 1 ELSE 0 END AS BIGINT) AS seats FROM y")
def seat_allocation(spark, sf):
    return au.seat_allocation(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("stratum")), 37)


@query("stratified_sample", "K10 K06", "WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY 1), x AS (SELECT stratum, n * 40.0 / sum(n) OVER () AS e FROM s), y AS (SELECT stratum, floor(e) AS b, row_number() OVER (ORDER BY round(e - floor(e), 12) DESC, stratum) AS rn, 40 - sum(floor(e)) OVER () AS l FROM x), z AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1('s|' || c_custkey)) AS i FROM customer) SELECT c_custkey, c_mktsegment FROM z JOIN y ON stratum = c_mktsegment WHERE i <= greatest(2, b + CASE WHEN rn <= l THEN 1 ELSE 0 END)")
def stratified_sample(spark, sf):
    return au.stratified_sample(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 40)


@query("deficit_cohort", "K12")
def deficit_cohort(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 5000).cast("int").alias("size"))
    rows = [r.asDict() for r in au.cohort_candidates(s, 30, "key", ["nation", "size"]).collect()]  # 30 rows of each of 50 combinations at most
    got = au.deficit_cohort(rows, {"nation": {n: 1 for n in range(25)}, "size": {0: 15, 1: 15}}, 30, ("nation", 4))
    return spark.createDataFrame([(int(k),) for k in got], "s_suppkey bigint")


@query("surface_partition", "K13", "SELECT s_suppkey, CAST((row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1) % 4 AS INT) AS writer FROM (SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 33)")
def surface_partition(spark, sf):
    return au.surface_partition(table(spark, sf, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")], 33, 4).select("s_suppkey", "writer")


@query("decoy_audit", "Z12", "WITH x AS (SELECT p_name AS item, min(p_type) AS label FROM part GROUP BY p_name), y AS (SELECT *, row_number() OVER (ORDER BY sha1('decoy|' || item), item) - 1 AS i, count(*) OVER () AS n FROM x) SELECT a.item, CASE WHEN a.i % 3 = 2 THEN b.label ELSE a.label END AS shown, NOT (a.i % 3 = 2 AND a.label <> b.label) AS real FROM y a JOIN y b ON b.i = (a.i + 1 + a.i % 7) % a.n")
def decoy_audit(spark, sf):
    return au.decoys(table(spark, sf, "part").groupBy(F.col("p_name").alias("item")).agg(F.min("p_type").alias("label")))


@query("folded_labels", "Z14", "SELECT CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'LITTLE' ELSE p_type END AS label, array_to_string(list(DISTINCT p_type ORDER BY p_type), ',') AS absorbed FROM part GROUP BY 1")
def folded_labels(spark, sf):
    folds = spark.createDataFrame([("SMALL", "LITTLE"), ("ECONOMY", "LITTLE")], "label string, into string")
    return au.fold_labels(table(spark, sf, "part").select(F.col("p_type").alias("label")), folds).select("label", F.concat_ws(",", "absorbed").alias("absorbed"))


@query("assigned_known", "Z15", "SELECT CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN p_type ELSE 'NONE' END AS p_type, count(*) AS n FROM part GROUP BY 1")
def assigned_known(spark, sf):
    v = spark.createDataFrame([("SMALL",), ("ECONOMY",)], "label string")
    return au.assign_known(table(spark, sf, "part"), v, "p_type").groupBy("p_type").agg(F.count("*").alias("n"))


@query("shard_batches", "Z10", "SELECT s_suppkey, CAST(floor((row_number() OVER (ORDER BY s_suppkey) - 1) / 6) AS BIGINT) AS batch FROM supplier")
def shard_batches(spark, sf):
    return rd.stamped_batches(table(spark, sf, "supplier"), "s_suppkey", 6)


@query("candidate_expansion", "J24 J25", f"WITH {an.CREW_SQL}, i AS (SELECT entity AS own, person FROM crew WHERE entity < 20), o AS (SELECT entity, person, role FROM crew WHERE entity >= 20) SELECT entity AS candidate, round(sum(n * CASE role WHEN 'A' THEN 2.0 ELSE 1.0 END), 6) AS score FROM (SELECT entity, o.person, role, count(DISTINCT own) AS n FROM o JOIN i USING (person) GROUP BY ALL) GROUP BY entity")
def candidate_expansion(spark, sf):
    ties = an.crew(spark, sf)
    return au.candidate_expansion(ties, an.entity(spark, sf).where("entity < 20"), {"A": 2.0, "N": 1.0, "R": 1.0}).select("candidate", F.round("score", 6).alias("score"))


@query("claim_kinds", "F24 S09", "SELECT l_partkey AS entity FROM lineitem WHERE l_linestatus <> 'X' AND l_returnflag <> 'R' GROUP BY l_partkey HAVING CASE WHEN max(CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END) = 1 THEN bool_or(l_quantity >= 40 AND l_suppkey % 10 = 0) ELSE bool_or(l_suppkey % 10 = 0) END")
def claim_kinds(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.lit("kind").alias("property"), (F.col("l_suppkey") % 10).cast("string").alias("value"), F.when(F.col("l_returnflag") == "R", "deprecated").when(F.col("l_quantity") >= 40, "preferred").otherwise("normal").alias("rank"))
    return va.claim_candidates(c, "kind", "0")


@query("nearest_year", "J08 K05", """WITH w AS (SELECT c_custkey AS key, c_mktsegment AS title, 1990 + c_custkey % 20 AS year FROM customer), c AS (SELECT p_partkey AS entity, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'][CAST(p_partkey % 5 AS INT) + 1] AS title, 1985 + p_size AS cy, p_partkey % 3 AS tier FROM part),
r AS (SELECT key, entity, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN year = cy THEN 0 ELSE 1 END, tier, entity) AS rn FROM w JOIN c USING (title) WHERE abs(year - cy) <= 1) SELECT key, entity FROM r WHERE rn = 1""")
def nearest_year(spark, sf):
    w = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("title"), (1990 + F.col("c_custkey") % 20).alias("year"))
    names = F.lit(["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"])
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("title"), (1985 + F.col("p_size")).alias("candidate_year"), (F.col("p_partkey") % 3).alias("tier"))
    return va.nearest_year(w, c)


@query("verified_match", "J09", "SELECT coalesce(CASE WHEN a.p_size = b.p_size THEN 'exact' WHEN abs(a.p_size - b.p_size) <= 1 THEN 'near' END, 'no') AS kind, count(*) AS n FROM part a JOIN part b ON a.p_name = b.p_name AND b.p_partkey = a.p_partkey + 64 GROUP BY 1")
def verified_match(spark, sf):
    p = table(spark, sf, "part")
    b = p.select((F.col("p_partkey") - 64).alias("p_partkey"), F.col("p_name").alias("name2"), F.col("p_size").alias("size2"))
    k = va.verified_match(F.col("p_name"), F.col("name2"), F.col("p_size"), F.col("size2"))
    return p.join(b, "p_partkey").where("p_name = name2").groupBy(F.coalesce(k, F.lit("no")).alias("kind")).agg(F.count("*").alias("n"))


@query("rarity_drift", "Z16 Z18", f"WITH {an.ATTR_SQL}, a AS (SELECT field, value, count(DISTINCT entity) AS n FROM entity_attr GROUP BY ALL), b AS (SELECT field, value, count(DISTINCT entity) AS n FROM entity_attr WHERE entity % 2 = 0 GROUP BY ALL), t AS (SELECT CAST(count(*) AS DOUBLE) AS whole, CAST(count(CASE WHEN p_partkey % 2 = 0 THEN 1 END) AS DOUBLE) AS half FROM part) SELECT round(median((ln(half / b.n) + 1) / (ln(whole / a.n) + 1)), 4) AS median_ratio FROM a JOIN b USING (field, value) CROSS JOIN t")
def rarity_drift(spark, sf):
    """Median ratio of idf + 1 between half the catalogue and all of it."""
    attrs = an.entity_attr(spark, sf)
    a, b = g.value_frequency(attrs), g.value_frequency(attrs.where("entity % 2 = 0")).withColumnRenamed("n", "m")
    whole, half = an.entity(spark, sf).agg(F.count("*"), F.count_if(F.col("entity") % 2 == 0)).first()
    return a.join(b, ["field", "value"]).agg(F.round(F.median((F.ln(float(half) / F.col("m")) + 1) / (F.ln(float(whole) / F.col("n")) + 1)), 4).alias("median_ratio"))
