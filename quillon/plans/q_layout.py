"""Layout, colour and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import colour as co
from quillon.operators import layout as lo
from quillon.operators import validate as va
from quillon.plans.registry import query, table
from quillon.sources import readers as rd

POINT_SQL = "pts AS (SELECT s_suppkey AS entity, (s_suppkey * 37 % 101) / 101.0 AS x, (s_suppkey * 53 % 97) / 97.0 AS y FROM supplier)"
EDGE_SQL = "ed AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b, (l_suppkey % 10 + 1) / 10.0 AS strength FROM lineitem WHERE l_suppkey < l_partkey % 100)"


def _points(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), (F.col("s_suppkey") * 37 % 101 / 101.0).alias("x"), (F.col("s_suppkey") * 53 % 97 / 97.0).alias("y"))


def _edges(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"))
    return x.where("a < b").distinct().withColumn("strength", (F.col("a") % 10 + 1) / 10.0)


@query("grid_neighbours", "J16", f"WITH {POINT_SQL} SELECT a.entity AS a, b.entity AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS d FROM pts a JOIN pts b ON a.entity <> b.entity WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.15")
def grid_neighbours(spark, sf):
    return lo.within(_points(spark, sf), 0.15).select("a", "b", F.round("d", 6).alias("d"))


@query("spatial_knn", "J15 K14", f"WITH {POINT_SQL}, p AS (SELECT a.entity AS a, b.entity AS b, row_number() OVER (PARTITION BY a.entity ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.entity) AS place FROM pts a JOIN pts b ON a.entity <> b.entity) SELECT a, b, place FROM p WHERE place <= 3")
def spatial_knn(spark, sf):
    return lo.nearest(_points(spark, sf), 3, 0.2, 4).select("a", "b", "place")


LENGTH_SQL = f"{POINT_SQL}, {EDGE_SQL}, ln AS (SELECT a, b, strength, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM ed JOIN pts p ON p.entity = a JOIN pts q ON q.entity = b)"


@query("bond_fit", "G17 M01", f"WITH {LENGTH_SQL}, r AS (SELECT rank() OVER (ORDER BY strength) + (count(*) OVER (PARTITION BY strength) - 1) / 2.0 AS x, rank() OVER (ORDER BY round(d, 9)) + (count(*) OVER (PARTITION BY round(d, 9)) - 1) / 2.0 AS y FROM ln) SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM r")
def bond_fit(spark, sf):
    from quillon.functions import stats as st

    d = lo.edge_lengths(_edges(spark, sf), _points(spark, sf)).withColumn("d", F.round("d", 9))
    return st.spearman(d, "strength", "d").select(F.round("rho", 6).alias("rho"), "n")


@query("closer_share", "G17", f"WITH {LENGTH_SQL}, m AS (SELECT sqrt(2 * (var_pop(x) + var_pop(y))) AS m FROM pts) SELECT round(avg(CASE WHEN d < m THEN 1.0 ELSE 0 END), 6) AS share FROM ln CROSS JOIN m")
def closer_share(spark, sf):
    return lo.closer_share(_edges(spark, sf), _points(spark, sf)).select(F.round("share", 6).alias("share"))


@query("weak_ratio", "G17", f"WITH {LENGTH_SQL} SELECT round(avg(CASE WHEN strength < 0.5 THEN d END) / avg(CASE WHEN strength >= 0.5 THEN d END), 6) AS ratio FROM ln")
def weak_ratio(spark, sf):
    return lo.weak_ratio(_edges(spark, sf), _points(spark, sf)).select(F.round("ratio", 6).alias("ratio"))


@query("degree_bias", "G17", f"WITH {POINT_SQL}, {EDGE_SQL}, g AS (SELECT entity, count(*) AS degree FROM (SELECT a AS entity FROM ed UNION ALL SELECT b FROM ed) GROUP BY entity), c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM pts), o AS (SELECT degree, round(sqrt((x - cx) ** 2 + (y - cy) ** 2), 9) AS far FROM pts JOIN g USING (entity) CROSS JOIN c), r AS (SELECT rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2.0 AS x, rank() OVER (ORDER BY far) + (count(*) OVER (PARTITION BY far) - 1) / 2.0 AS y FROM o) SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM r")
def degree_bias(spark, sf):
    return lo.degree_bias(_edges(spark, sf), _points(spark, sf)).select(F.round("rho", 6).alias("rho"), "n")


@query("neighbour_lift", "G17 J15", f"WITH {POINT_SQL}, p AS (SELECT a.entity AS a, b.entity AS b, row_number() OVER (PARTITION BY a.entity ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.entity) AS place FROM pts a JOIN pts b ON a.entity <> b.entity), c AS (SELECT entity % 5 AS g, count(*) AS c FROM pts GROUP BY 1) SELECT round((SELECT avg(CASE WHEN a % 5 = b % 5 THEN 1.0 ELSE 0 END) FROM p WHERE place <= 3) / (SELECT sum(c * (c - 1.0)) / (sum(c) * (sum(c) - 1.0)) FROM c), 6) AS lift")
def neighbour_lift(spark, sf):
    groups = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), (F.col("s_suppkey") % 5).alias("g"))
    return lo.neighbour_lift(_points(spark, sf), groups, 3, 0.2).select(F.round("lift", 6).alias("lift"))


@query("strata_layout", "G14 G15 X08")
def strata_layout(spark, sf):
    e = _edges(spark, sf).withColumn("signal", F.when(F.col("a") % 9 == 0, "genre").otherwise("crew")).withColumn("stratum", F.concat(F.lit("s"), (F.col("a") % 3).cast("string")))
    return lo.layout_strata(e, 20, 40, {"s0": ["genre"]}).groupBy("stratum").agg(F.count("*").alias("n"), F.max("x").alias("x"))


@query("answer_layout", "G16 W05")
def answer_layout(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), (F.floor(F.col("s_acctbal") / 1000) / 10).alias("score"), (F.col("s_suppkey") * 2 * F.pi() / 100).alias("angle"))
    return lo.band_ratio(s, lo.query_layout(s, 20))


@query("snapshot_check", "G20 M17")
def snapshot_check(spark, sf):
    v = lo.solver_version({"rounds": 300, "spread": 1.0})
    ok = {"version": v, "points": {"1": [0.1, 0.2]}}
    cases = [("good", lo.valid_snapshot(ok, v, {"1"})), ("version", lo.valid_snapshot(ok, lo.solver_version({"rounds": 301, "spread": 1.0}), {"1"})), ("entities", lo.valid_snapshot(ok, v, {"2"})), ("numbers", lo.valid_snapshot({"version": v, "points": {"1": [float("inf"), 0]}}, v, {"1"}))]
    return spark.createDataFrame(cases, "snapshot string, why string")


HEX_SQL = "'#' || lpad(lower(to_hex((p_partkey * 7919 + 1000) % 16777216)), 6, '0')"


def _colour():
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_partkey") * 7919 + 1000) % 16777216)), 6, "0"))


@query("colour_luminance", "M10", f"WITH c AS (SELECT p_partkey, {HEX_SQL} AS h FROM part), v AS (SELECT p_partkey, h, list_transform([2, 4, 6], lambda i: ('0x' || substring(h, i, 2))::INT / 255.0) AS v FROM c), l AS (SELECT p_partkey, h, list_transform(v, lambda x: CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE power((x + 0.055) / 1.055, 2.4) END) AS l FROM v) SELECT p_partkey, h AS colour, round(0.2126 * l[1] + 0.7152 * l[2] + 0.0722 * l[3], 6) AS luminance FROM l")
def colour_luminance(spark, sf):
    return table(spark, sf, "part").select("p_partkey", _colour().alias("colour")).withColumn("luminance", F.round(co.luminance(F.col("colour")), 6))


_LIN = "list_transform([2, 4, 6], lambda i: CASE WHEN ('0x' || substring(h, i, 2))::INT / 255.0 <= 0.04045 THEN ('0x' || substring(h, i, 2))::INT / 255.0 / 12.92 ELSE power((('0x' || substring(h, i, 2))::INT / 255.0 + 0.055) / 1.055, 2.4) END)"
_LMS = ", ".join(f"cbrt({' + '.join(f'{w} * l[{i + 1}]' for i, w in enumerate(row))})" for row in co.TO_LMS)
_LAB = [" + ".join(f"{w} * m[{i + 1}]" for i, w in enumerate(row)) for row in co.TO_LAB]
_WHITE = [sum(w * sum(row) ** (1 / 3) for w, row in zip(lab, co.TO_LMS, strict=True)) for lab in co.TO_LAB]


@query("oklab_separation", "A50 M10", f"WITH c AS (SELECT p_type, {HEX_SQL} AS h FROM part), l AS (SELECT p_type, {_LIN} AS l FROM c), m AS (SELECT p_type, l, [{_LMS}] AS m FROM l) SELECT p_type, round(avg(sqrt({' + '.join(f'({x} - ({w})) ** 2' for x, w in zip(_LAB, _WHITE, strict=True))})), 6) AS d, round(avg((0.2126 * l[1] + 0.7152 * l[2] + 0.0722 * l[3] + 0.05) / 0.05), 6) AS contrast FROM m GROUP BY p_type")
def oklab_separation(spark, sf):
    """Mean Oklab distance of types' colours from white."""
    return table(spark, sf, "part").withColumn("c", _colour()).groupBy("p_type").agg(F.round(F.avg(co.oklab_distance(F.col("c"), F.lit("#ffffff"))), 6).alias("d"), F.round(F.avg(co.contrast(F.col("c"), F.lit("#000000"))), 6).alias("contrast"))


@query("era_palette", "M11", "WITH h AS (SELECT DISTINCT p_size, p_size * 7 / 30.0 AS h FROM part), k AS (SELECT p_size, list_transform([0, 8, 4], lambda n: (n + h) - 12 * floor((n + h) / 12)) AS k FROM h) SELECT p_size, '#' || array_to_string(list_transform(k, lambda x: lpad(lower(to_hex(CAST(floor((0.5 - 0.2 * greatest(-1.0, least(x - 3, 9 - x, 1.0))) * 255 + 0.5) AS BIGINT))), 2, '0')), '') AS colour FROM k")
def era_palette(spark, sf):
    return table(spark, sf, "part").select("p_size").distinct().select("p_size", co.hsl_hex((F.col("p_size") * 7).cast("double"), F.lit(0.4), F.lit(0.5)).alias("colour"))


@query("hue_peaks", "M12 S18")
def hue_peaks(spark, sf):
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        got = co.hue_peaks(pdf["h"].to_numpy(float), np.ones(len(pdf)))
        return pd.DataFrame({"p_type": [pdf["p_type"].iloc[0]], "peaks": [got]})

    return table(spark, sf, "part").select("p_type", (F.col("p_partkey") * 13 % 360).cast("double").alias("h")).groupBy("p_type").applyInPandas(run, "p_type string, peaks array<double>")


@query("seed_lines", "S04", "SELECT p_partkey, p_name AS title, 1916 + 2 * p_size AS year FROM part")
def seed_lines(spark, sf):
    lines = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" ("), (1916 + 2 * F.col("p_size")).cast("string"), F.lit(")")).alias("line"))
    parsed = rd.parse_seed(lines.select("line").distinct())
    return lines.join(parsed, "line").select("p_partkey", "title", "year")


@query("duration_pick", "S10 A38", "WITH c AS (SELECT l_partkey AS entity, CASE WHEN l_returnflag = 'A' THEN l_quantity * 60 ELSE l_quantity END AS m, l_discount >= 0.08 AS pref FROM lineitem WHERE l_returnflag <> 'R'), b AS (SELECT entity, bool_or(pref) AS any_pref FROM c GROUP BY entity), d AS (SELECT entity, list_sort(list(DISTINCT round(m, 3))) AS s FROM c JOIN b USING (entity) WHERE NOT any_pref OR pref GROUP BY entity) SELECT entity, s[CAST(floor((len(s) - 1) / 2) AS INT) + 1] AS minutes FROM d")
def duration_pick(spark, sf):
    line = table(spark, sf, "lineitem")
    c = line.select(F.col("l_partkey").alias("entity"), F.col("l_quantity").alias("amount"), F.when(F.col("l_returnflag") == "A", "hour").otherwise("minute").alias("unit"), F.when(F.col("l_returnflag") == "R", "deprecated").when(F.col("l_discount") >= 0.08, "preferred").otherwise("normal").alias("rank"))
    return rd.durations(c)


@query("view_sums", "S14 S15", "SELECT user_id AS title, count(*) AS views FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-12' GROUP BY user_id")
def view_sums(spark, sf):
    v = table(spark, sf, "events").select(F.col("user_id").alias("title"), F.to_date("ts").alias("day"), F.lit(1).alias("views"))
    return rd.summed_views(v, "2024-01-05", 7)


@query("modal_window", "S15", "SELECT max_by(start, n * 1000000 + start) AS start, max(n) AS n FROM (SELECT p_size AS start, count(*) AS n FROM part GROUP BY 1)")
def modal_window(spark, sf):
    return rd.modal_window(table(spark, sf, "part").select(F.col("p_size").alias("start")))


@query("redirects", "S13", "SELECT s_suppkey AS name, CASE WHEN s_suppkey < 5 THEN 0 ELSE greatest(0, s_suppkey - 5) END AS target FROM supplier")
def redirects(spark, sf):
    s = table(spark, sf, "supplier")
    return rd.follow_redirects(s.select(F.col("s_suppkey").alias("name")), s.where("s_suppkey > 0").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") - 1).alias("to")))


@query("key_batches", "S12 S08 S16", "SELECT CAST(floor(i / 50) AS BIGINT) AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) GROUP BY 1")
def key_batches(spark, sf):
    return rd.batches(table(spark, sf, "supplier"), "s_suppkey", 50).select("batch", F.size("keys").cast("bigint").alias("n"))


@query("extended_columns", "S11", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS extra FROM part")
def extended_columns(spark, sf):
    p = table(spark, sf, "part")
    known = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("extra"))
    return rd.extend(known, p.select("p_partkey", F.col("p_brand").alias("extra")), "p_partkey", ["extra"])


@query("json_attributes", "S01 F05 S27", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_attributes(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("fenced_replies", "S01 F08", "SELECT p_partkey, p_size AS score FROM part")
def fenced_replies(spark, sf):
    reply = F.concat(F.lit("Here:\n```json\n{\"score\": "), F.col("p_size").cast("string"), F.lit("}\n```\ndone"))
    return table(spark, sf, "part").select("p_partkey", rd.fenced_json(reply, "score int")["score"].alias("score"))


@query("best_search_count", "S17", "WITH lib AS (SELECT q, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct(list_concat([p_name], string_split(p_name, ' ')))) AS q FROM part) GROUP BY q), u AS (SELECT DISTINCT p_name, i, CASE i WHEN 1 THEN p_name || '!' WHEN 2 THEN p_name WHEN 3 THEN string_split(p_name, ' ')[1] ELSE string_split(p_name, ' ')[-1] END AS variant FROM part, range(1, 5) t(i)), r AS (SELECT p_name, variant, n, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, i) AS rn FROM u JOIN lib ON q = variant) SELECT p_name, variant, n FROM r WHERE rn = 1")
def best_search_count(spark, sf):
    """The spelling variant of each name that a library (here: names and their words) has most hits for."""
    part, words = table(spark, sf, "part"), F.split("p_name", " ")
    library = part.select(F.explode(F.array_distinct(F.concat(F.array("p_name"), words))).alias("query")).groupBy("query").agg(F.count("*").alias("n"))
    return rd.best_counts(part, "p_name", F.array(F.concat("p_name", F.lit("!")), "p_name", F.element_at(words, 1), F.element_at(words, -1)), library)


KINDS = ("ffd8ffe0", "89504e470d0a1a0a00", "474946383961", "474946383761", "52494646000000005745425056", "52494646000000005741564500", "424d0000", "25504446")


@query("image_kinds", "S18", "SELECT p_partkey, [ 'jpeg', 'png', 'gif', 'gif', 'webp', NULL, 'bmp', NULL][CAST(p_partkey % 8 AS INT) + 1] AS kind FROM part")
def image_kinds(spark, sf):
    """What the first bytes of a file say; other RIFF files and documents are no images."""
    content = F.unhex(F.concat(F.element_at(F.lit(list(KINDS)), (F.col("p_partkey") % 8 + 1).cast("int")), F.lit("0011223344")))
    return table(spark, sf, "part").select("p_partkey", rd.image_kind(content).alias("kind"))


@query("vocabulary_split", "F05", "SELECT source AS attr, source IN (SELECT 'src' || i FROM range(0, 9) t(i)) AS kept, count(*) AS n FROM documents GROUP BY ALL")
def vocabulary_split(spark, sf):
    """Clauses within a closed vocabulary, and those dropped, which are reported."""
    vocabulary = spark.range(9).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("attr"))
    kept, dropped = va.split_by_vocabulary(table(spark, sf, "documents").select(F.col("source").alias("attr")), vocabulary)
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False))).groupBy("attr", "kept").agg(F.count("*").alias("n"))


@query("property_scan", "S09 S11", "SELECT l_orderkey AS entity, l_returnflag AS property, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def property_scan(spark, sf):
    claims = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_returnflag").alias("property"))
    return rd.property_rows(claims, ["A", "R"]).groupBy("entity", "property").agg(F.count("*").alias("n"))
