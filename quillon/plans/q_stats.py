"""Statistics queries."""

from __future__ import annotations

from itertools import islice

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import stats as st
from quillon.operators.facets import row_numbers
from quillon.plans.registry import query, table

RANK_SQL = "rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0"


@query("average_ranks", "W01", "SELECT p_partkey, round(rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0, 6) AS r FROM part")
def average_ranks(spark, sf):
    return st.average_rank(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "r").select("p_partkey", F.round("r", 6).alias("r"))


@query("ordinal_ranks", "W02", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS r FROM customer")
def ordinal_ranks(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", st.ordinal_rank("c_acctbal", "c_custkey", ["c_mktsegment"]).alias("r"))


@query("rank_percentile", "W03", "SELECT p_partkey, round(1 - (rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 - 1) / (count(*) OVER () - 1), 6) AS pct FROM part")
def rank_percentile(spark, sf):
    return st.rank_percentile(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "pct").select("p_partkey", F.round("pct", 6).alias("pct"))


@query("tie_bands", "W04", "SELECT p_size, width, CAST(sum(width) OVER (ORDER BY p_size DESC) AS BIGINT) AS to_rank, CAST(sum(width) OVER (ORDER BY p_size DESC) AS BIGINT) - width + 1 AS from_rank FROM (SELECT p_size, count(*) AS width FROM part GROUP BY p_size)")
def tie_bands(spark, sf):
    return st.tie_bands(table(spark, sf, "part"), "p_size")


@query("fame_decile", "W06 A44", """WITH v AS (SELECT user_id, count(*) AS views FROM events GROUP BY user_id), d AS (SELECT user_id, views, least(9, CAST(floor((rank() OVER (ORDER BY views) - 1) * 10 / count(*) OVER ()) AS INT)) AS decile FROM v)
SELECT decile, count(*) AS n, sum(views) AS views FROM d GROUP BY decile""")
def fame_decile(spark, sf):
    views = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("views"))
    return st.decile(views, "views", "decile").groupBy("decile").agg(F.count("*").alias("n"), F.sum("views").alias("views"))


@query("decile_cuts", "W07", "WITH o AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT d, min(v) AS cut FROM o CROSS JOIN range(1, 10) t(d) WHERE i = floor(n * d / 10) GROUP BY d")
def decile_cuts(spark, sf):
    return st.order_statistic_cuts(table(spark, sf, "customer"), "c_acctbal")


@query("spearman_fame", "M01 W01", """WITH v AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS x, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS y FROM v)
SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM r""")
def spearman_fame(spark, sf):
    v = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey", "c_acctbal").agg(F.count("*").alias("orders"))
    return st.spearman(v, "c_acctbal", "orders").select(F.round("rho", 6).alias("rho"), "n")


@query("partial_spearman", "W22", """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS z FROM lineitem WHERE l_linenumber = 1),
c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r) SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS rho FROM c""")
def partial_spearman(spark, sf):
    return st.partial_spearman(table(spark, sf, "lineitem").where("l_linenumber = 1"), "l_quantity", "l_extendedprice", "l_discount").select(F.round("rho", 6).alias("rho"))


@query("four_medians", "M03 M04 A38", """SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q25, median(l_extendedprice) AS averaged,
list_sort(list(l_extendedprice))[CAST(floor(count(*) / 2) AS INT) + 1] AS upper, list_sort(list(DISTINCT l_quantity))[CAST(floor((count(DISTINCT l_quantity) - 1) / 2) AS INT) + 1] AS lower_distinct FROM lineitem GROUP BY l_returnflag""")
def four_medians(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(st.quantile_linear("l_quantity", 0.25).alias("q25"), st.averaged_median("l_extendedprice").alias("averaged"), st.upper_median("l_extendedprice").alias("upper"), st.lower_median_distinct("l_quantity").alias("lower_distinct"))


@query("sample_deviation", "M06", "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 6) AS sd FROM customer GROUP BY c_mktsegment")
def sample_deviation(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.round(F.stddev_samp("c_acctbal"), 6).alias("sd"))


@query("rank_degeneracy", "M14 A22", "SELECT p_type, round(max(c) * 1.0 / sum(c), 6) AS modal_share, max(c) * 1.0 / sum(c) >= 0.95 AS degenerate FROM (SELECT p_type, p_size, count(*) AS c FROM part GROUP BY ALL) GROUP BY p_type")
def rank_degeneracy(spark, sf):
    c = table(spark, sf, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("c")).groupBy("p_type").agg((F.max("c") / F.sum("c")).alias("s"))
    return c.select("p_type", F.round("s", 6).alias("modal_share"), (F.col("s") >= 0.95).alias("degenerate"))


@query("pair_inversions", "M15 A42", """SELECT a.n_regionkey AS region, count(*) AS pairs, count(CASE WHEN (a.n_nationkey < b.n_nationkey) <> (a.bal < b.bal) AND a.bal <> b.bal THEN 1 END) AS inversions
FROM (SELECT n_regionkey, n_nationkey, sum(c_acctbal) AS bal FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL) a JOIN (SELECT n_regionkey, n_nationkey, sum(c_acctbal) AS bal FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL) b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY 1""")
def pair_inversions(spark, sf):
    """Pairs of a region's nations whose order by key and by balance disagree."""
    n = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.sum("c_acctbal").alias("bal"))
    a, b = n.toDF("region", "ka", "ba"), n.toDF("region", "kb", "bb")
    return a.join(b, "region").where("ka < kb").groupBy("region").agg(F.count("*").alias("pairs"), F.count_if((F.col("ba") > F.col("bb"))).alias("inversions"))


@query("hashes", "M09 K06", "SELECT p_partkey, sha1('salt|' || p_name) AS s1, sha256(p_name) AS s256 FROM part")
def hashes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.sha1(F.concat(F.lit("salt|"), "p_name").cast("binary")).alias("s1"), F.sha2("p_name", 256).alias("s256"))


FNV_SQL = "list_reduce(list_concat([2166136261::HUGEINT], list_transform(range(1, length({x}) + 1), lambda i: ascii({x}[i])::HUGEINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295)"


@query("fnv_hash", "M09 K07", f"SELECT DISTINCT p_name, CAST({FNV_SQL.format(x='p_name')} AS BIGINT) AS h, CAST(list_reduce(list_concat([5381::HUGEINT], list_transform(range(1, length(p_name) + 1), lambda i: ascii(p_name[i])::HUGEINT)), lambda a, c: (a * 33 + c) & 4294967295) AS BIGINT) AS d FROM part")
def fnv_hash(spark, sf):
    return table(spark, sf, "part").select("p_name").distinct().select("p_name", st.fnv1a32(F.col("p_name")).alias("h"), st.djb2(F.col("p_name")).alias("d"))


@query("poisson_surprise", "A04", """WITH x AS (SELECT n_nationkey AS k, 0.25 * (1 + n_regionkey) AS lam FROM nation)
SELECT k, lam, round(CASE WHEN k <= 0 THEN 0.0 ELSE least(12.0, -log10(greatest(1e-300, 1 - (SELECT sum(exp(-lam) * lam ** i / gamma(i + 1)) FROM range(0, 25) t(i) WHERE i < k)))) END, 6) AS s FROM x""")
def poisson_surprise(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (0.25 * (1 + F.col("n_regionkey"))).alias("lam"))
    return n.select("k", "lam", F.round(st.poisson_surprise(F.col("k"), F.col("lam")), 6).alias("s"))


@query("poisson_continuous", "A05", """WITH x AS (SELECT n_nationkey AS k, 0.25 * (1 + n_regionkey) AS lam FROM nation)
SELECT k, lam, round(CASE WHEN k <= 0 THEN 0.0 ELSE least(12.0, -log10(greatest(1e-300, (SELECT sum(exp(-lam) * lam ** i / gamma(i + 1)) FROM range(0, 80) t(i) WHERE i >= k)))) END, 6) AS s FROM x""")
def poisson_continuous(spark, sf):
    """The continuous tail equals the discrete one at integers."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (0.25 * (1 + F.col("n_regionkey"))).alias("lam"))
    return n.select("k", "lam", F.round(st.continuous_surprise_udf()(F.col("k").cast("double"), F.col("lam").cast("double")), 6).alias("s"))


@query("bootstrap_interval", "M02 M08")
def bootstrap_interval(spark, sf):
    return st.bootstrap_by_group(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "c_custkey", 100)


@query("permutation_test", "M13")
def permutation_test(spark, sf):
    return st.permutation_p(table(spark, sf, "supplier"), "s_nationkey", "s_acctbal", 100)


@query("p_value", "M05")
def p_value(spark, sf):
    r = spearman_fame(spark, sf).first()
    return spark.createDataFrame([(r["rho"], r["n"], st.correlation_p_value(r["rho"], r["n"]))], "rho double, n bigint, p double")


@query("single_group_null", "A32", "SELECT round(sum(CASE WHEN c >= 3 THEN c * (c - 1.0) * (c - 2) / (n * (n - 1.0) * (n - 2)) ELSE 0 END), 9) AS p FROM (SELECT c_mktsegment, count(*) AS c, sum(count(*)) OVER () AS n FROM customer GROUP BY c_mktsegment)")
def single_group_null(spark, sf):
    sizes = [r["n"] for r in table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).collect()]
    return spark.createDataFrame([(round(st.hypergeometric_single(3, sizes), 9),)], "p double")


DAY = "CAST(floor(epoch(ts) / 86400) AS BIGINT)"


@query("adaptive_window", "W10 W11", f"""WITH d AS (SELECT {DAY} AS day, count(*) AS n, sum(value) AS s FROM events GROUP BY 1), w AS (SELECT a.day, k, sum(b.n) AS n, sum(b.s) AS s FROM d a CROSS JOIN range(0, 16) t(k) JOIN d b ON abs(a.day - b.day) <= k GROUP BY a.day, k),
p AS (SELECT day, k, n, s, row_number() OVER (PARTITION BY day ORDER BY k) AS rn FROM w WHERE n >= 70 OR k = 15), g AS (SELECT sum(s) / sum(n) AS mean FROM d)
SELECT day, CAST(k AS INT) AS half, CAST(n AS BIGINT) AS n, round(s / n * (n / (n + 45.0)) + mean * (1 - n / (n + 45.0)), 6) AS shrunk FROM p CROSS JOIN g WHERE rn = 1""")
def adaptive_window(spark, sf):
    """Windows of days around each day, grown until they hold 70 events; means shrunk to the whole by n / (n + 45)."""
    d = table(spark, sf, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    grown = d.select("day").withColumn("half", F.explode(F.sequence(F.lit(0), F.lit(15))))
    near = grown.withColumn("at", F.explode(F.sequence(F.col("day") - F.col("half"), F.col("day") + F.col("half")))).join(d.withColumnRenamed("day", "at"), "at")
    w = near.groupBy("day", "half").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n >= 70 OR half = 15").groupBy("day").agg(F.min_by(F.struct("half", "n", "s"), "half").alias("x")).select("day", "x.*")
    keep = F.col("n") / (F.col("n") + 45.0)
    return w.join(F.broadcast(d.agg((F.sum("s") / F.sum("n")).alias("mean")))).select("day", "half", "n", F.round(F.col("s") / F.col("n") * keep + F.col("mean") * (1 - keep), 6).alias("shrunk"))


@query("smoothed_series", "W12", f"""WITH d AS (SELECT {DAY} AS day, count(*) AS n FROM events GROUP BY 1)
SELECT day, round(0.25 * lag(n, 1, n) OVER (ORDER BY day) + 0.5 * n + 0.25 * lead(n, 1, n) OVER (ORDER BY day), 6) AS smooth FROM d""")
def smoothed_series(spark, sf):
    d = table(spark, sf, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")
    return d.select("day", F.round(0.25 * F.coalesce(F.lag("n").over(w), "n") + 0.5 * F.col("n") + 0.25 * F.coalesce(F.lead("n").over(w), "n"), 6).alias("smooth"))


@query("sliding_centroid", "W13", """WITH y AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS z FROM orders),
c AS (SELECT s.m, avg(y.x) AS x, avg(y.z) AS z FROM (SELECT DISTINCT m FROM y) s JOIN y ON y.m BETWEEN s.m - 2 AND s.m + 2 GROUP BY s.m HAVING count(*) >= 8),
d AS (SELECT m, x, z, sqrt((x - lag(x) OVER (ORDER BY m)) ** 2 + (z - lag(z) OVER (ORDER BY m)) ** 2) AS step FROM c)
SELECT round(sum(step), 4) AS path, round(sqrt((max_by(x, m) - min_by(x, m)) ** 2 + (max_by(z, m) - min_by(z, m)) ** 2), 4) AS drift FROM d""")
def sliding_centroid(spark, sf):
    """Five-month centroids of at least eight orders: length of the path and net drift."""
    o = table(spark, sf, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("z"))
    months = o.groupBy("m").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("z").alias("z"))
    near = months.withColumn("at", F.explode(F.array(*(F.col("m") + k for k in range(-2, 3))))).join(months.select(F.col("m").alias("at")), "at")
    c = near.groupBy("at").agg(F.sum("n").alias("n"), (F.sum("x") / F.sum("n")).alias("x"), (F.sum("z") / F.sum("n")).alias("z")).where("n >= 8")
    w = Window.orderBy("at")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("z") - F.lag("z").over(w)) ** 2)
    ends = lambda c: F.max_by(c, "at") - F.min_by(c, "at")
    return c.withColumn("step", step).agg(F.round(F.sum("step"), 4).alias("path"), F.round(F.sqrt(ends("x") ** 2 + ends("z") ** 2), 4).alias("drift"))


SEEN = "WITH f AS (SELECT o_clerk, min(i) AS i FROM (SELECT o_custkey AS o_clerk, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) GROUP BY o_clerk)"


@query("saturation_curve", "W14 W16", f"""{SEEN}, c AS (SELECT CAST(floor((i - 1) / 100) AS BIGINT) AS win, count(*) AS fresh FROM f GROUP BY 1) SELECT win, fresh, CAST(sum(fresh) OVER (ORDER BY win) AS BIGINT) AS seen FROM c""")
def saturation_curve(spark, sf):
    """Distinct customers after each hundred orders, and how many are new."""
    i = row_numbers(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_orderkey").select("o_custkey", F.col("row").alias("i"))
    first = i.groupBy("o_custkey").agg(F.min("i").alias("i")).groupBy(F.floor(F.col("i") / 100).alias("win")).agg(F.count("*").alias("fresh"))
    return first.withColumn("seen", F.sum("fresh").over(Window.orderBy("win")))


@query("rarefaction", "W15")
def rarefaction(spark, sf):
    """Mean number of distinct customers after k orders over eight hashed permutations."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("perm"))
    i = o.withColumn("i", F.row_number().over(Window.partitionBy("perm").orderBy(F.xxhash64("perm", "o_orderkey"))))
    first = i.groupBy("perm", "o_custkey").agg(F.min("i").alias("i")).groupBy("perm", F.floor(F.col("i") / 100).alias("win")).agg(F.count("*").alias("fresh"))
    curve = first.withColumn("seen", F.sum("fresh").over(Window.partitionBy("perm").orderBy("win")))
    return curve.groupBy("win").agg(F.avg("seen").alias("seen"))


@query("adjacent_margins", "W20", "SELECT s_suppkey, round(s_acctbal - lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), 6) AS margin FROM supplier")
def adjacent_margins(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") - F.lag("s_acctbal").over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")), 6).alias("margin"))


@query("round_robin_strata", "W21", "SELECT c_custkey FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) ORDER BY rn, c_mktsegment LIMIT 40")
def round_robin_strata(spark, sf):
    """The first forty customers taken in turn from each segment (the limit is the sample's size)."""
    c = table(spark, sf, "customer").withColumn("rn", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")))
    return c.orderBy("rn", "c_mktsegment").limit(40).select("c_custkey")


@query("circular_bearings", "W17", "SELECT s_suppkey, round(2 * pi() * (row_number() OVER (ORDER BY atan2(s_acctbal - 4000, s_nationkey - 12), s_suppkey) - 1) / count(*) OVER (), 6) AS bearing FROM supplier")
def circular_bearings(spark, sf):
    s = table(spark, sf, "supplier").select(F.struct(F.atan2(F.col("s_acctbal") - 4000, (F.col("s_nationkey") - 12).cast("double")).alias("t"), "s_suppkey").alias("o"))
    return row_numbers(s, "o").select("o.s_suppkey", F.round(2 * F.pi() * F.col("row") / s.count(), 6).alias("bearing"))


@query("generators", "M08", "WITH s AS (SELECT n_nationkey AS seed, i FROM nation, range(1, 6) t(i)), a AS (SELECT seed, i, (seed + i * 1831565813::HUGEINT) % 4294967296 AS a FROM s), t AS (SELECT seed, i, a, (xor(a, a // 32768) * (a + 1 - a % 2)) % 4294967296 AS t FROM a), u AS (SELECT seed, i, xor((t + (xor(t, t // 128) * (t - (t & 61) + 61)) % 4294967296) % 4294967296, t) AS u FROM t) SELECT seed, CAST(i AS INT) AS i, round(xor(u, u // 16384) / 4294967296.0, 9) AS x FROM u")
def generators(spark, sf):
    """Five draws of the 32-bit generator for each of some seeds."""
    def run(batches):
        for b in batches:
            yield pd.DataFrame([(int(s), i, round(x, 9)) for s in b["seed"] for i, x in enumerate(islice(st.mulberry32(int(s)), 5), 1)], columns=["seed", "i", "x"])

    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("seed")).mapInPandas(run, "seed bigint, i int, x double")


@query("congruential_draws", "M08", "WITH RECURSIVE r(seed, i, s) AS (SELECT n_nationkey::HUGEINT, 0, n_nationkey::HUGEINT FROM nation UNION ALL SELECT seed, i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM r WHERE i < 5) SELECT CAST(seed AS BIGINT) AS seed, i, round(s / 4294967296.0, 9) AS x FROM r WHERE i > 0")
def congruential_draws(spark, sf):
    def run(batches):
        for b in batches:
            yield pd.DataFrame([(int(s), i, round(x, 9)) for s in b["seed"] for i, x in enumerate(islice(st.lcg(int(s)), 5), 1)], columns=["seed", "i", "x"])

    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("seed")).mapInPandas(run, "seed bigint, i int, x double")


@query("score_bands", "W05", "WITH b AS (SELECT p_size AS s, count(*) AS width, dense_rank() OVER (ORDER BY p_size DESC) AS band FROM part GROUP BY p_size) SELECT s, band, width, CAST(sum(width) OVER (ORDER BY band) AS BIGINT) AS filled, round((s + lead(s, 1, s) OVER (ORDER BY band)) / 2.0, 6) AS edge FROM b")
def score_bands(spark, sf):
    """A band for each distinct score, its edge half-way to the next."""
    b = table(spark, sf, "part").groupBy(F.col("p_size").alias("s")).agg(F.count("*").alias("width")).withColumn("band", F.dense_rank().over(Window.orderBy(F.desc("s"))))
    w = Window.orderBy("band")
    return b.select("s", "band", "width", F.sum("width").over(w).alias("filled"), F.round((F.col("s") + F.coalesce(F.lead("s").over(w), "s")) / 2, 6).alias("edge"))


@query("first_wins", "W19 X02 J25", "SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1")
def first_wins(spark, sf):
    """The first row of each name: a partial aggregation, not a window."""
    return table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@query("histogram", "A40", "SELECT least(9, CAST(floor(p_size / 10.0) AS INT)) AS bin, count(*) AS n FROM part GROUP BY 1")
def histogram(spark, sf):
    return table(spark, sf, "part").groupBy(F.least(F.lit(9), F.floor(F.col("p_size") / 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("between_within", "A51", "WITH y AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS d, o_totalprice AS v FROM orders), m AS (SELECT avg(v) AS g, var_pop(v) * count(*) AS total FROM y), b AS (SELECT d, count(*) AS n, avg(v) AS a FROM y GROUP BY d) SELECT round(sum(n * (a - g) ** 2) / max(total), 9) AS share FROM b CROSS JOIN m")
def between_within(spark, sf):
    """Share of the sum of squares that lies between years."""
    y = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("d")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("a"), (F.var_pop("o_totalprice") * F.count("*")).alias("within"))
    grand = F.sum(F.col("n") * F.col("a")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("a") * F.col("a")) - F.sum("n") * grand * grand
    return y.agg(F.round(between / (between + F.sum("within")), 9).alias("share"))


@query("jaccard", "A23", """WITH a AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS f, l_partkey AS p FROM lineitem), s AS (SELECT f, count(DISTINCT p) AS n FROM a GROUP BY f),
i AS (SELECT x.f AS f, y.f AS g, count(DISTINCT x.p) AS c FROM a x JOIN a y ON x.p = y.p AND x.f < y.f GROUP BY 1, 2) SELECT i.f, i.g, round(c * 1.0 / (s.n + t.n - c), 6) AS j FROM i JOIN s ON s.f = i.f JOIN s t ON t.f = i.g""")
def jaccard(spark, sf):
    """Overlap of the parts under each pair of return flags."""
    a = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_partkey").alias("p")).distinct()
    n = a.groupBy("f").agg(F.count("*").alias("n"))
    i = a.join(a.select(F.col("f").alias("g"), "p"), "p").where("f < g").groupBy("f", "g").agg(F.count("*").alias("c"))
    out = i.join(n, "f").join(n.select(F.col("f").alias("g"), F.col("n").alias("m")), "g")
    return out.select("f", "g", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 6).alias("j"))
