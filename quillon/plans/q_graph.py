"""Association-graph queries over parts, their values and their customers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import audit as au
from quillon.operators import graph as g
from quillon.plans import analogue as an
from quillon.plans.q_stats import FNV_SQL
from quillon.plans.registry import query, shared_checkpoints, table

IDF_SQL = f"{an.ATTR_SQL}, {an.ENTITY_SQL}, tot AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM part), freq AS (SELECT field, value, count(DISTINCT entity) AS n FROM entity_attr GROUP BY field, value), av AS (SELECT a.*, f.n, CASE WHEN total <= 1 THEN 0 ELSE least(1.0, ln(total / f.n) / ln(total)) END AS idf FROM entity_attr a JOIN freq f USING (field, value) CROSS JOIN tot)"
SHARED_SQL = f"{IDF_SQL}, sh AS (SELECT x.entity AS a, y.entity AS b, x.field, x.value, x.idf FROM av x JOIN av y ON x.field = y.field AND x.value = y.value AND x.entity < y.entity)"
SOME = "field = 'keyword' OR field = 'country'"


def _attrs(spark, sf):
    return g.with_idf(an.entity_attr(spark, sf), an.entity(spark, sf).count())


@query("value_frequency", "A01 A02 F01", f"WITH {IDF_SQL} SELECT DISTINCT field, value, n, round(idf, 6) AS idf FROM av")
def value_frequency(spark, sf):
    return _attrs(spark, sf).select("field", "value", "n", F.round("idf", 6).alias("idf")).distinct()


@query("expected_overlap", "A03", f"WITH {IDF_SQL} SELECT entity, round(sum((n - 1) / greatest(1.0, total - 1)), 6) AS lam FROM av CROSS JOIN tot WHERE field = 'keyword' GROUP BY entity")
def expected_overlap(spark, sf):
    return g.expected_overlap(_attrs(spark, sf).where("field = 'keyword'"), an.entity(spark, sf).count()).select("entity", F.round("lam", 6).alias("lam"))


@query("shared_values", "J01 J02", f"WITH {SHARED_SQL} SELECT field, value, count(*) AS pairs FROM sh GROUP BY field, value")
def shared_values(spark, sf):
    return g.shared_counts(_attrs(spark, sf))


@query("shared_lists", "J02 K01", f"WITH {SHARED_SQL} SELECT a, b, array_to_string(list(value ORDER BY round(idf, 12) DESC, value), ',') AS vals FROM sh WHERE field = 'keyword' GROUP BY a, b HAVING count(*) > 1")
def shared_lists(spark, sf):
    attrs = _attrs(spark, sf).where("field = 'keyword'").withColumn("idf", F.round("idf", 12))
    of, values = g.value_sets(attrs)
    return g.members_of_pairs(of, g.set_lists(values, 2).select("x", "y", F.concat_ws(",", "values").alias("vals")))


LINEAR_SQL = "SELECT a, b, '{s}' AS signal, round(least({c}, {x} + {y} * max(idf)), 3) AS strength FROM sh WHERE field = '{f}' {w} GROUP BY a, b HAVING max(idf) >= {fl}"


@query("proposals_country", "J10 A02 T16", f"WITH {SHARED_SQL} SELECT signal, strength, count(*) AS n FROM ({LINEAR_SQL.format(s='genre', c=0.34, x=0.18, y=0.22, f='country', w='', fl=0.14)}) GROUP BY ALL")
def proposals_country(spark, sf):
    return g.linear_counts(_attrs(spark, sf), "country", "genre")


@query("proposals_country_era", "J10", f"WITH {SHARED_SQL}, p AS (SELECT sh.* FROM sh JOIN entity x ON x.entity = a JOIN entity y ON y.entity = b WHERE abs(x.year - y.year) <= 9) SELECT signal, strength, count(*) AS n FROM (SELECT a, b, 'countryEra' AS signal, round(least(0.30, 0.16 + 0.20 * max(idf)), 3) AS strength FROM p WHERE field = 'country' GROUP BY a, b) GROUP BY ALL")
def proposals_country_era(spark, sf):
    return g.era_counts(_attrs(spark, sf), an.entity(spark, sf), "country", "countryEra")


@query("country_pairs", "J10 J01", f"WITH {SHARED_SQL} SELECT a, b, round(least(0.34, 0.18 + 0.22 * max(idf)), 3) AS strength, any_value(value) AS brand FROM sh WHERE field = 'country' GROUP BY a, b HAVING max(idf) >= 0.14")
def country_pairs(spark, sf):
    """The pairs that proposals_country counts."""
    of, values = g.value_sets(_attrs(spark, sf).where("field = 'country'"))
    sets = g.linear_proposals(g.set_lists(values, 1).withColumnsRenamed({"x": "a", "y": "b"}), "country", "genre")
    return g.members_of_pairs(of, sets.withColumnsRenamed({"a": "x", "b": "y"})).select("a", "b", "strength", F.element_at("values", 1).alias("brand"))


@query("setting_pairs", "J01 J02 A02", f"WITH {SHARED_SQL} SELECT strength, words, count(*) AS n FROM (SELECT a, b, round(least(0.64, 0.28 + 0.44 * max(idf)), 3) AS strength, count(*) AS words FROM sh WHERE field = 'keyword' GROUP BY a, b HAVING max(idf) >= 0.28) GROUP BY ALL")
def setting_pairs(spark, sf):
    """Pairs over the floor with all that they share, also values under it."""
    lists = g.lists_over(_attrs(spark, sf).where("field = 'keyword'"), g.FLOOR["setting"])
    return g.linear_proposals(lists, "keyword", "setting").groupBy("strength", F.size("values").cast("bigint").alias("words")).agg(F.count("*").alias("n"))


SURPRISE_SQL = "CASE WHEN {l} <= 0 THEN 12.0 ELSE least(12.0, -log10(greatest(1e-300, 1 - (SELECT sum(exp(-{l}) * {l} ** i / gamma(i + 1)) FROM range(0, 25) t(i) WHERE i < {k})))) END"


@query("keyword_pairs", "A04 A03 J02", f"WITH {SHARED_SQL}, lam AS (SELECT entity, sum((n - 1) / greatest(1.0, total - 1)) AS lam FROM av CROSS JOIN tot WHERE field = 'keyword' GROUP BY entity), p AS (SELECT a, b, count(*) AS k FROM sh WHERE field = 'keyword' GROUP BY a, b HAVING count(*) >= 3), q AS (SELECT k, (x.lam + y.lam) / 2 AS l FROM p JOIN lam x ON x.entity = a JOIN lam y ON y.entity = b) SELECT strength, count(*) AS n FROM (SELECT round(least(0.78, 0.40 + 0.34 * least(1.0, {SURPRISE_SQL.format(l='l', k='k')} / 6)), 3) AS strength FROM q) GROUP BY strength")
def keyword_pairs(spark, sf):
    """Pairs that share three words at least, by the Poisson surprise of it."""
    attrs = _attrs(spark, sf).where("field = 'keyword'")
    return g.keyword_counts(attrs, an.entity(spark, sf).count())


@query("subject_pairs", "A02 J02", f"WITH {SHARED_SQL}, s AS (SELECT a, b, list_sort(list(idf), 'DESC') AS i FROM sh WHERE field = 'keyword' AND idf >= 0.28 GROUP BY a, b) SELECT strength, count(*) AS n FROM (SELECT round(least(0.72, 0.30 + 0.5 * (i[1] + 0.25 * coalesce(i[2], 0))), 3) AS strength FROM s) GROUP BY strength")
def subject_pairs(spark, sf):
    """Words as subjects: the two rarest over the floor count."""
    attrs = _attrs(spark, sf).where("field = 'keyword'").withColumn("field", F.lit("subject"))
    return g.subject_proposals(g.lists_over(attrs, g.FLOOR["subject"])).groupBy("strength").agg(F.count("*").alias("n"))


CREW_PAIRS_SQL = f"{an.CREW_SQL}, cp AS (SELECT x.entity AS a, y.entity AS b, x.person, CASE x.role WHEN 'A' THEN 0.62 WHEN 'N' THEN 0.58 ELSE 0.46 END AS w FROM crew x JOIN crew y ON x.role = y.role AND x.person = y.person AND x.entity < y.entity), cs AS (SELECT a, b, round(least(0.82, max(w) + 0.18 * (sum(w) - max(w))), 3) AS strength, count(DISTINCT person) AS people FROM cp GROUP BY a, b)"
FLAGS = {"A": 0.62, "N": 0.58, "R": 0.46}


@query("crew_proposals", "J03 A06", f"WITH {CREW_PAIRS_SQL} SELECT strength, people, count(*) AS n FROM cs GROUP BY ALL")
def crew_proposals(spark, sf):
    return g.crew_proposals(an.crew(spark, sf), FLAGS).select("strength", F.size("values").cast("bigint").alias("people")).groupBy("strength", "people").agg(F.count("*").alias("n"))


@query("directed_references", "J04", "SELECT count(*) AS n, min(l_partkey) AS lo FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_suppkey WHERE l_partkey <> l_suppkey)")
def directed_references(spark, sf):
    refs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("source")).distinct()
    return g.reference_proposals(refs, an.entity(spark, sf)).agg(F.count("*").alias("n"), F.min("b").alias("lo"))


@query("two_hop_join", "J05", "SELECT c_custkey, count(DISTINCT n_regionkey) AS regions FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY c_custkey")
def two_hop_join(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count_distinct("n_regionkey").alias("regions"))


def _proposals(spark, sf):
    attrs, total = _attrs(spark, sf), an.entity(spark, sf).count()
    words = attrs.where("field = 'keyword'")
    crew = g.crew_proposals(an.crew(spark, sf), FLAGS)
    same = g.linear_proposals(g.lists_over(attrs.where("field = 'country'"), g.FLOOR["genre"]), "country", "genre")
    setting = g.linear_proposals(g.lists_over(words, g.FLOOR["setting"]), "keyword", "setting")
    keyword = g.keyword_proposals(g.lists_sharing(words, 3), g.expected_overlap(words, total))
    return same.unionByName(setting).unionByName(keyword).unionByName(crew)


def _edges(spark, sf):
    """Chosen among all of :func:`_proposals`, of which those of crews and countries are made in the pass itself."""
    attrs, total = _attrs(spark, sf), an.entity(spark, sf).count()
    words = attrs.where("field = 'keyword'")
    crew, crew_lots = g.crew_lots(an.crew(spark, sf), FLAGS)
    same, same_lots = g.linear_lots(attrs, "country", "genre")
    setting = g.linear_proposals(g.lists_over(words, g.FLOOR["setting"]), "keyword", "setting")
    keyword = g.keyword_proposals(g.lists_sharing(words, 3), g.expected_overlap(words, total))
    proposals = same.unionByName(setting).unionByName(keyword).unionByName(crew)
    return g.select_edges(proposals, an.entity(spark, sf), lots=crew_lots.unionByName(same_lots))


@query("selected_edges", "G02 K01 W08 T16")
def selected_edges(spark, sf):
    return _edges(spark, sf)


def _alternates(spark, sf, chosen):
    """What :func:`_proposals` has of the chosen pairs under other signals than theirs."""
    attrs, total = _attrs(spark, sf), an.entity(spark, sf).count()
    words = attrs.where("field = 'keyword'")
    of = lambda signal: chosen.where(F.col("signal") != signal).select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    same = g.linear_proposals(g.shared_of(of("genre"), attrs.where("field = 'country'")), "country", "genre")
    setting = g.linear_proposals(g.shared_of(of("setting"), words), "keyword", "setting")
    keyword = g.keyword_proposals(g.shared_of(of("keyword"), words), g.expected_overlap(words, total))
    return same.unionByName(setting).unionByName(keyword).unionByName(g.crew_of(of("crew"), an.crew(spark, sf), FLAGS))


@query("also_signals", "G03")
def also_signals(spark, sf):
    shared_checkpoints(spark)
    chosen = _edges(spark, sf).checkpoint()
    return g.runners_up(_alternates(spark, sf, chosen), chosen).select("pair", F.size("also").alias("n"))


EDGE_SQL = "e AS (SELECT DISTINCT l_partkey AS a, 1000000 + l_suppkey AS b FROM lineitem)"


def _bipartite(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).distinct()


TREE_SQL = "e AS (SELECT CAST(1000 + n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation UNION ALL SELECT 1000000000000 + c_custkey, 1000 + c_nationkey FROM customer UNION ALL SELECT 2000000000000 + s_suppkey, 1000 + s_nationkey FROM supplier)"


def _tree(spark, sf):
    """Customers and suppliers tied to nations, and these to regions."""
    ends = (("nation", 1000, "n_nationkey", 0, "n_regionkey"), ("customer", 1000000000000, "c_custkey", 1000, "c_nationkey"), ("supplier", 2000000000000, "s_suppkey", 1000, "s_nationkey"))
    return reduce(DataFrame.union, [table(spark, sf, t).select((F.col(a) + x).cast("bigint").alias("a"), (F.col(b) + y).cast("bigint").alias("b")) for t, x, a, y, b in ends])


def _components(spark, edges):
    shared_checkpoints(spark)
    nodes = edges.select(F.col("a").alias("entity")).union(edges.select("b")).distinct()
    return au.component_sizes(g.connected_components(nodes, edges))


@query("components", "G01 A56", f"WITH RECURSIVE {TREE_SQL}, n AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), r(u, root) AS (SELECT DISTINCT u, u FROM n UNION SELECT n.v, r.root FROM r JOIN n ON n.u = r.u) SELECT root AS component, count(*) AS n FROM (SELECT u, min(root) AS root FROM r GROUP BY u) GROUP BY root")
def components(spark, sf):
    return _components(spark, _tree(spark, sf))


@query("line_components", "G01 A56", "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, 1000000000000 + l_orderkey AS b FROM lineitem), n AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), r(u) AS (SELECT min(a) FROM e UNION SELECT n.v FROM r JOIN n ON n.u = r.u) SELECT min(u) AS component, count(*) AS n FROM r")
def line_components(spark, sf):
    """The component of the first part, among parts and orders tied by all order lines."""
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_orderkey") + 1000000000000).alias("b")).distinct()
    return _components(spark, e).orderBy("component").limit(1)


@query("degrees", "A56", f"WITH {EDGE_SQL}, d AS (SELECT a AS entity FROM e UNION ALL SELECT b FROM e) SELECT entity, count(*) AS degree FROM d GROUP BY entity")
def degrees(spark, sf):
    return g.degrees(_bipartite(spark, sf))


@query("bfs_distance", "G09", f"WITH RECURSIVE {EDGE_SQL}, n AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), w(u, hops) AS (SELECT CAST(1000001 AS BIGINT), 0 UNION SELECT n.v, hops + 1 FROM w JOIN n ON n.u = w.u WHERE hops < 3) SELECT hops, count(*) AS n FROM (SELECT u, min(hops) AS hops FROM w GROUP BY u) GROUP BY hops")
def bfs_distance(spark, sf):
    source = spark.createDataFrame([(1000001,)], "entity bigint")
    return g.bfs_distance(_bipartite(spark, sf), source, 3).groupBy("hops").agg(F.count("*").alias("n"))


@query("common_neighbours", "G10 J13", f"WITH {EDGE_SQL} SELECT x.b AS a, y.b AS b, count(*) AS n FROM e x JOIN e y ON x.a = y.a AND x.b < y.b GROUP BY 1, 2")
def common_neighbours(spark, sf):
    """Suppliers by the parts that both sell; parts and suppliers are kept apart whatever their keys are."""
    return g.neighbours_in_common(_bipartite(spark, sf).select(F.col("a").alias("u"), F.col("b").alias("v")))


@query("merge_authored", "J06 Z27 X01", """WITH rec AS (SELECT DISTINCT l_partkey AS a, 5000000 + l_suppkey AS b, 'crew' AS signal, 0.5 AS strength FROM lineitem WHERE l_quantity >= 40),
au AS (SELECT a, b, signal, strength FROM (SELECT l_partkey AS a, 5000000 + l_suppkey AS b, 'reading' AS signal, l_discount AS strength, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS rn FROM lineitem WHERE l_returnflag = 'A') WHERE rn = 1)
SELECT source, count(*) AS n, round(sum(strength), 4) AS s, count(also) AS also FROM (SELECT 'reading' AS source, au.strength, rec.signal AS also FROM au LEFT JOIN rec ON au.a = rec.a AND au.b = rec.b UNION ALL SELECT 'record', rec.strength, NULL FROM rec ANTI JOIN au ON au.a = rec.a AND au.b = rec.b) GROUP BY source""")
def merge_authored(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("a", F.col("l_partkey")).withColumn("b", F.col("l_suppkey") + 5000000)
    rec = line.where("l_quantity >= 40").select("a", "b", F.lit("crew").alias("signal"), F.lit(0.5).alias("strength")).distinct()
    authored = line.where("l_returnflag = 'A'").select("a", "b", F.lit("reading").alias("signal"), F.col("l_discount").alias("strength"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    # several lines of one order share an ordinal's order number; the line number makes it total
    return g.merge_authored(rec, authored).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("strength"), 4).alias("s"), F.count("also_record").alias("also"))


@query("predictability", "G06", "SELECT l_orderkey, l_linenumber, round((CASE WHEN l_suppkey = l_partkey % 100 THEN 0.34 WHEN l_suppkey % 5 = l_partkey % 5 THEN 0.55 ELSE 1 END) * (CASE WHEN l_quantity <= 6 THEN 0.86 ELSE 1 END) * (1 + least(0.45, l_quantity / 90.0)) * (CASE WHEN l_returnflag = 'A' THEN 0.72 ELSE 1 END), 6) AS s FROM lineitem")
def predictability(spark, sf):
    x = table(spark, sf, "lineitem")
    s = g.predictability(F.col("l_suppkey") == F.col("l_partkey") % 100, F.col("l_suppkey") % 5 == F.col("l_partkey") % 5, F.col("l_quantity"), F.when(F.col("l_returnflag") == "A", "hand").otherwise("rhyme"))
    return x.select("l_orderkey", "l_linenumber", F.round(s, 6).alias("s"))


STRONG_SQL = f"{CREW_PAIRS_SQL}, ce AS (SELECT * FROM cs WHERE strength >= 0.75)"


def _crew_edges(spark, sf):
    return g.crew_proposals(an.crew(spark, sf), FLAGS).where("strength >= 0.75").withColumn("claim", g.claim(F.col("values")))


def _hands(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("hand"))


@query("ego_map", "G04", f"WITH {STRONG_SQL} SELECT CASE WHEN a = 100 THEN b ELSE a END AS other, strength FROM ce WHERE a = 100 OR b = 100 ORDER BY strength DESC, other LIMIT 6")
def ego_map(spark, sf):
    return g.ego_map(_crew_edges(spark, sf), 100).select("other", "strength")


@query("connections", "G05 G07 W18")
def connections(spark, sf):
    return g.connections(_crew_edges(spark, sf), _hands(spark, sf), an.entity(spark, sf))


@query("recommend", "G08 A46 J23", f"""WITH {STRONG_SQL}, w AS (SELECT a AS u, b AS v, strength * 0.60 AS w FROM ce UNION ALL SELECT b, a, strength * 0.60 FROM ce),
s AS (SELECT v AS entity, round(sum(w), 9) AS score, max_by(u, w * 1e6 + u / 1e6) AS because FROM w WHERE u IN (1, 2, 3, 4, 5) AND v NOT IN (1, 2, 3, 4, 5) GROUP BY v),
t AS (SELECT s.*, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, entity) AS turn FROM s JOIN part ON p_partkey = entity)
SELECT entity, score, because FROM t ORDER BY CASE WHEN turn <= 2 THEN 0 ELSE 1 END, score DESC, entity LIMIT 12""")
def recommend(spark, sf):
    loved = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "entity bigint")
    return g.recommend(_crew_edges(spark, sf), loved, _hands(spark, sf))


@query("authoring_queue", "G18", f"WITH {STRONG_SQL}, d AS (SELECT entity, count(*) AS n FROM (SELECT a AS entity FROM ce UNION ALL SELECT b FROM ce) GROUP BY entity) SELECT p_partkey AS entity, coalesce(n, 0) AS degree FROM part LEFT JOIN d ON entity = p_partkey WHERE coalesce(n, 0) < 11")
def authoring_queue(spark, sf):
    return g.authoring_queue(an.entity(spark, sf), _crew_edges(spark, sf))


@query("ordered_edges", "K01 T16 M09", f"""WITH {CREW_PAIRS_SQL}, p AS (SELECT a, b, strength, list(DISTINCT CAST(person AS VARCHAR) ORDER BY CAST(person AS VARCHAR)) AS v, least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) || '|' || greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS pair FROM cs JOIN cp USING (a, b) WHERE strength >= 0.75 GROUP BY a, b, strength),
c AS (SELECT pair, strength, CASE WHEN len(v) = 1 THEN v[1] ELSE array_to_string(v[:-2], ', ') || ' and ' || v[-1] END AS claim, CAST({FNV_SQL.format(x='pair')} AS BIGINT) AS h FROM p) SELECT row_number() OVER (ORDER BY strength DESC, claim, h, pair) AS place, pair FROM c ORDER BY place LIMIT 100""")
def ordered_edges(spark, sf):
    """The first hundred of the strong crew edges in the one total order (a report's size)."""
    best = g.total_order(_crew_edges(spark, sf).drop("claim")).orderBy(*g.order_columns()).limit(100)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*g.order_columns())).cast("bigint")).select("place", "pair")


@query("type_pruning", "G13", f"""WITH {STRONG_SQL}, t AS (SELECT a, b, strength, least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) || '|' || greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS edge, CASE WHEN a % 2 = 0 THEN 'hand' ELSE 'rhyme' END AS type, CASE WHEN b % 50 = 0 THEN 'reading' ELSE 'record' END AS source FROM ce),
w AS (SELECT a AS u, * FROM t UNION ALL SELECT b, * FROM t), x AS (SELECT *, row_number() OVER (PARTITION BY u, type ORDER BY strength DESC, edge) AS turn FROM w), y AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY source = 'reading' DESC, turn, strength DESC, edge) AS place FROM x)
SELECT type, source, count(*) AS n FROM t WHERE edge IN (SELECT edge FROM y WHERE place <= 6 OR source = 'reading') GROUP BY type, source""")
def type_pruning(spark, sf):
    e = _crew_edges(spark, sf).withColumn("type", F.when(F.col("a") % 2 == 0, "hand").otherwise("rhyme")).withColumn("source", F.when(F.col("b") % 50 == 0, "reading").otherwise("record"))
    return g.prune_by_type(e, 6).groupBy("type", "source").agg(F.count("*").alias("n"))


@query("ballot_edges", "G19", f"WITH {STRONG_SQL}, x AS (SELECT p_brand AS hand, p_partkey AS entity, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn FROM part WHERE 1916 + 2 * p_size <= 2010) SELECT x.entity AS anchor, count(*) AS n FROM x JOIN part ON p_brand = hand AND p_partkey <> x.entity WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ce WHERE (a = x.entity AND b = p_partkey) OR (b = x.entity AND a = p_partkey)) GROUP BY x.entity")
def ballot_edges(spark, sf):
    return g.ballot_edges(an.entity(spark, sf), _hands(spark, sf), _crew_edges(spark, sf), 2010).groupBy("anchor").agg(F.count("*").alias("n"))


@query("compatible_groups", "G11")
def compatible_groups(spark, sf):
    brands = [r[0] for r in table(spark, sf, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    clash = {frozenset((a, b)) for a in brands for b in brands if a < b and len(a) == len(b) and a[-1] == b[-1]}
    return spark.createDataFrame([(i, x) for i, grp in enumerate(g.compatible_groups(brands, clash)) for x in grp], "grp int, brand string")


@query("connected_core", "G12")
def connected_core(spark, sf):
    """Forty well-connected parts around two anchors (a report's size)."""
    e = [(r["a"], r["b"]) for r in _crew_edges(spark, sf).select("a", "b").collect()]
    core = g.connected_core(sorted({x for p in e for x in p}), e, [1, 2], 40)
    return spark.createDataFrame([(int(x),) for x in core], "entity bigint")
