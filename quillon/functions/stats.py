"""Statistics: ranks, correlations, medians, tails, seeded resampling.

The four medians and the two Spearmans of the domain are different functions on
purpose; none stands in for another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(by: list[str]) -> Window:
    return Window.partitionBy(*by)


def average_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Fractional ranks, ties sharing their mean.  Counted per distinct value first, so that the window runs over values."""
    by = by or []
    n = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(_window(by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    keys = [*by, value]
    ranks = n.withColumn(out, F.coalesce(before, F.lit(0)) + (F.col("_n") + 1) / 2).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), out)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(ranks, on).drop(*(f"_k{i}" for i in range(len(keys))))


def ordinal_rank(value: str, tie: str, by: list[str] | None = None) -> Column:
    """Ranks without tie averaging (the other Spearman)."""
    return F.row_number().over(_window(by or []).orderBy(value, tie))


def pearson(x: str, y: str) -> Column:
    """Correlation; null below three pairs or where either side is constant."""
    ok = (F.count(F.col(x) + F.col(y)) >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    n, sx, sy = F.count(F.col(x) + F.col(y)), F.sum(x), F.sum(y)
    cov = F.sum(F.col(x) * F.col(y)) - sx * sy / n
    vx, vy = F.sum(F.col(x) * F.col(x)) - sx * sx / n, F.sum(F.col(y) * F.col(y)) - sy * sy / n
    return F.when(ok, F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson over average ranks, rows with a null left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_rank(average_rank(rows, x, "_rx", by), y, "_ry", by)
    return r.groupBy(*(by or [])).agg(pearson("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Rank correlation of x and y with z held fixed."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    for c in (x, y, z):
        r = average_rank(r, c, f"_r{c}")
    c = r.agg(pearson(f"_r{x}", f"_r{y}").alias("xy"), pearson(f"_r{x}", f"_r{z}").alias("xz"), pearson(f"_r{y}", f"_r{z}").alias("yz"))
    return c.select(F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("rho"))


def rank_percentile(df: DataFrame, value: str, out: str, eps_digits: int = 9) -> DataFrame:
    """1 - (mid rank - 1) / (n - 1), best first, values equal to ``eps_digits`` tied."""
    key = df.withColumn("_neg", -F.round(value, eps_digits))
    r = average_rank(key, "_neg", "_r")
    n = df.agg(F.count("*").alias("_n"))
    return r.join(F.broadcast(n)).withColumn(out, F.when(F.col("_n") > 1, 1 - (F.col("_r") - 1) / (F.col("_n") - 1)).otherwise(1.0)).drop("_neg", "_r", "_n")


def tie_bands(df: DataFrame, value: str) -> DataFrame:
    """(value, width, from_rank, to_rank) of each distinct value, best first."""
    n = df.groupBy(value).agg(F.count("*").alias("width"))
    upto = F.sum("width").over(Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("to_rank", upto).withColumn("from_rank", F.col("to_rank") - F.col("width") + 1)


def decile(df: DataFrame, value: str, out: str) -> DataFrame:
    """min(9, floor(10 * rows below / rows)): not ``ntile``."""
    n = df.groupBy(value).agg(F.count("*").alias("_n"))
    w = Window.orderBy(value)
    below = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy())
    d = n.select(value, F.least(F.lit(9), F.floor(10 * below / total)).cast("int").alias(out))
    return df.join(d, value)


def order_statistic_cuts(df: DataFrame, value: str, parts: int = 10) -> DataFrame:
    """(d, cut): the value at place floor(n d / parts) of the order, d from 1."""
    runs = df.groupBy(value).agg(F.count("*").alias("c"))
    upto = runs.withColumn("upto", F.sum("c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    total = df.agg(F.count("*").alias("n")).select("n", F.explode(F.sequence(F.lit(1), F.lit(parts - 1))).alias("d")).withColumn("place", F.floor(F.col("n") * F.col("d") / parts))
    return upto.join(F.broadcast(total), F.col("upto") > F.col("place")).groupBy("d").agg(F.min(value).alias("cut"))


def quantile_linear(value: str, p: float) -> Column:
    """Linear-interpolated quantile."""
    return F.percentile(value, p)


def upper_median(value: str) -> Column:
    """s[floor(n / 2)]."""
    s = F.array_sort(F.collect_list(value))
    return F.element_at(s, (F.floor(F.count(value) / 2) + 1).cast("int"))


def lower_median_distinct(value: str) -> Column:
    """Lower median of the distinct values."""
    s = F.array_sort(F.collect_set(value))
    return F.element_at(s, (F.floor((F.size(s) - 1) / 2) + 1).cast("int"))


def averaged_median(value: str) -> Column:
    return F.median(value)


def idf(n: Column, total: Column) -> Column:
    """min(1, ln(N / n) / ln N); 0 for n <= 0, and for N <= 1."""
    return F.when((n <= 0) | (total <= 1), 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.ln(total / n), F.ln(total))))


def poisson_surprise(k: Column, lam: Column, most: float = 12.0) -> Column:
    """-log10 P(X >= k) for X ~ Poisson(lam), at most ``most``; 0 for k <= 0, ``most`` for lam <= 0."""
    start = F.struct(F.lit(0.0).alias("cum"), F.exp(-lam).alias("term"))
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), start, lambda s, i: F.struct((s["cum"] + s["term"]).alias("cum"), (s["term"] * lam / i).alias("term")))
    tail = F.greatest(1.0 - done["cum"], F.lit(1e-300))
    return F.when(k <= 0, 0.0).when(lam <= 0, most).otherwise(F.least(F.lit(most), -F.log10(tail)))


def regularised_gamma_lower(a: float, x: float) -> float:
    """P(a, x), by its series below a + 1 and its continued fraction above."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def poisson_surprise_continuous(k: pd.Series, lam: pd.Series, most: float = 12.0) -> pd.Series:
    """As :func:`poisson_surprise` for real k, by the regularised lower incomplete gamma function."""
    out = []
    for x, mean in zip(k, lam, strict=True):
        if x is None or mean is None or math.isnan(x) or math.isnan(mean):
            out.append(None)
        elif x <= 0:
            out.append(0.0)
        elif mean <= 0:
            out.append(most)
        else:
            p = regularised_gamma_lower(x, mean)
            out.append(min(most, -math.log10(p)) if p > 0 else most)
    return pd.Series(out, dtype="float64")


def continuous_surprise_udf():
    """Arrow-batched form of :func:`poisson_surprise_continuous`."""
    from quillon.functions import stats

    def run(k: pd.Series, lam: pd.Series) -> pd.Series:
        return stats.poisson_surprise_continuous(k, lam)

    return F.pandas_udf(run, "double")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def correlation_p_value(r: float, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs under Student's t."""
    if n < 3 or r is None or abs(r) >= 1:
        return None if n < 3 or r is None else 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def hypergeometric_single(k: int, sizes: list[int]) -> float:
    """Chance that k rows drawn without replacement all come from one of the groups of these sizes."""
    n = sum(sizes)
    logs = lambda s: sum(math.log(s - i) - math.log(n - i) for i in range(k)) if s >= k else -math.inf
    return sum(math.exp(x) for x in map(logs, sizes) if x > -math.inf) if k <= n else 0.0


def mulberry32(seed: int) -> Iterator[float]:
    """The public 32-bit generator, in [0, 1)."""
    a, mask = seed & 0xFFFFFFFF, 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & mask
        t = ((a ^ (a >> 15)) * (1 | a)) & mask
        t = (((t + ((t ^ (t >> 7)) * (61 | t) & mask)) & mask) ^ t) & mask
        yield ((t ^ (t >> 14)) & mask) / 4294967296


def xorshift32(seed: int) -> Iterator[float]:
    """Marsaglia's 13, 17, 5 generator, in [0, 1)."""
    x = seed & 0xFFFFFFFF or 1
    while True:
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        yield x / 4294967296


def lcg(seed: int, a: int = 1664525, c: int = 1013904223) -> Iterator[float]:
    """Linear congruential generator modulo 2**32, in [0, 1)."""
    x = seed & 0xFFFFFFFF
    while True:
        x = (a * x + c) & 0xFFFFFFFF
        yield x / 4294967296


def _ranks(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rank(method="average").to_numpy()


def _rho(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) < 3:
        return math.nan
    a, b = _ranks(x), _ranks(y)
    return float(np.corrcoef(a, b)[0, 1]) if a.std() and b.std() else math.nan


def bootstrap_interval(x: np.ndarray, y: np.ndarray, rounds: int = 500, seed: int = 42) -> tuple[float, float]:
    """2.5 % and 97.5 % points of Spearman's rho over resamples."""
    rng, n, got = xorshift32(seed), len(x), []
    for _ in range(rounds):
        i = np.array([int(next(rng) * n) for _ in range(n)])
        r = _rho(x[i], y[i])
        if not math.isnan(r):
            got.append(r)
    got.sort()
    return (got[int(0.025 * (len(got) - 1))], got[math.ceil(0.975 * (len(got) - 1))]) if got else (math.nan, math.nan)


def bootstrap_by_group(df: DataFrame, key: str, x: str, y: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """(key, lo, hi) of each group's interval; a group is one task's work, so groups are samples."""
    from quillon.functions import stats

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.dropna(subset=["x", "y"]).sort_values(["x", "y"])
        lo, hi = stats.bootstrap_interval(own["x"].to_numpy(), own["y"].to_numpy(), rounds, seed)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "lo": [lo], "hi": [hi]})

    return df.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).groupBy("key").applyInPandas(run, "key string, lo double, hi double")


def permutation_p(df: DataFrame, group: str, value: str, rounds: int = 500, seed: int = 1) -> DataFrame:
    """(observed, p): spread of group means against shuffled labels with sizes fixed; one replicate a row of work."""
    from quillon.operators.facets import row_numbers

    rows = df.where(F.col(value).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v"))
    sums = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    observed = sums.agg((F.max("m") - F.min("m")).alias("observed"))
    indexed = row_numbers(rows.groupBy("g", "v").agg(F.count("*").alias("c")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("c")))).select(F.struct("g", "v", "i").alias("key")), "key").select("key.g", "key.v", F.col("row").alias("i"))
    order = Window.partitionBy("r").orderBy(F.xxhash64(F.lit(seed), "r", "i"), "i")
    replicate = indexed.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("j", F.row_number().over(order) - 1)
    labels = indexed.select(F.col("i").alias("j"), F.col("g").alias("h"))
    spread = replicate.join(labels, "j").groupBy("r", "h").agg(F.avg("v").alias("m")).groupBy("r").agg((F.max("m") - F.min("m")).alias("s"))
    return spread.join(F.broadcast(observed)).groupBy("observed").agg(((F.count_if(F.col("s") >= F.col("observed") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as a long."""
    h = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(h) > 0, F.sequence(F.lit(1), F.greatest(F.length(h) - 1, F.lit(1)), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(2166136261).cast("bigint"), lambda acc, i: ((acc.bitwiseXOR(F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("bigint"))) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")))


def djb2(text: Column) -> Column:
    """djb2 (33 h + c) over code points, modulo 2**32."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(5381).cast("bigint"), lambda acc, c: (acc * 33 + F.ascii(c)).bitwiseAND(F.lit(4294967295).cast("bigint")))


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(x + 0.5)
