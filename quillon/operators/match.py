"""Three-valued attribute matching: a query re-orders entities and never filters them.

``values(entity, attr, value)`` is sparse: a row over 0 holds, a row of 0 is
known absent, no row is unknown.  Nothing here fills unknowns with 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clause:
    """One demand: any of the terms, with a weight; ``negate`` asks for the complement."""

    any_of: tuple[str, ...]
    weight: float = 1.0
    negate: bool = False
    label: str = ""


def clause_terms(spark: SparkSession, clauses: Sequence[Clause]) -> DataFrame:
    """(clause, weight, pos, attr): a negated term is the complement attribute ``not:x``."""
    rows = [(i, float(c.weight), p, ("not:" if c.negate else "") + a) for i, c in enumerate(clauses) for p, a in enumerate(c.any_of)]
    return spark.createDataFrame(rows, "clause int, weight double, pos int, attr string")


def complements(values: DataFrame) -> DataFrame:
    """``not:attr`` with 1 - value; an unknown stays unknown."""
    return values.select("entity", F.concat(F.lit("not:"), "attr").alias("attr"), (1.0 - F.col("value")).alias("value"))


def with_complements(values: DataFrame) -> DataFrame:
    return values.unionByName(complements(values))


def value_surprisal(values: DataFrame) -> DataFrame:
    """(attr, value, n, sigma): -log10((entities at least as strong + .5) / (known + .5)), 0 for a value of 0.

    Counted per distinct value first, so that the window runs over values, not entities.
    """
    counted = values.groupBy("attr", "value").agg(F.count("*").alias("n"))
    stronger = Window.partitionBy("attr").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("attr")
    sigma = -F.log10((F.sum("n").over(stronger) + 0.5) / (F.sum("n").over(every) + 0.5))
    return counted.select("attr", "value", "n", F.when(F.col("value") > 0, sigma).otherwise(0.0).alias("sigma"))


def attribute_model(values: DataFrame) -> DataFrame:
    """(attr, known, max_value, prior, sigma_max, prevalence) of each attribute over the entities known on it."""
    s = value_surprisal(values)
    return s.groupBy("attr").agg(
        F.sum("n").alias("known"),
        F.max("value").alias("max_value"),
        (F.sum(F.col("n") * F.col("sigma")) / F.sum("n")).alias("prior"),
        F.max("sigma").alias("sigma_max"),
        (F.sum(F.when(F.col("value") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("prevalence"),
    )


def clause_model(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(clause, weight, ceiling, prior): best over the clause's terms; a clause nobody is known on has ceiling 0."""
    model = attribute_model(values.join(F.broadcast(terms.select("attr").distinct()), "attr", "left_semi"))
    return terms.join(model, "attr", "left").groupBy("clause", "weight").agg(F.coalesce(F.max("sigma_max"), F.lit(0.0)).alias("ceiling"), F.coalesce(F.max("prior"), F.lit(0.0)).alias("prior"))


def clause_credit(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(entity, clause, weight, value, attr, credit) of clauses that an entity is known on: its best term, ties to the first."""
    used = values.join(F.broadcast(terms), "attr")  # terms: one query's, a handful
    sigma = value_surprisal(values.join(F.broadcast(terms.select("attr").distinct()), "attr", "left_semi")).select("attr", "value", "sigma")
    best = F.max_by(F.struct("attr", "value", "sigma"), F.struct("sigma", "value", -F.col("pos"))).alias("b")
    return used.join(sigma, ["attr", "value"]).groupBy("entity", "clause", "weight").agg(best, F.max("value").alias("value")).select("entity", "clause", "weight", "value", F.col("b.attr").alias("attr"), F.col("b.sigma").alias("credit"))


def match_parts(entities: DataFrame, values: DataFrame, terms: DataFrame) -> DataFrame:
    """(entity, raw, denom, hold, known_weight, total_weight): what a score is made of.

    raw starts from every clause's prior and is corrected where the entity is
    known, so that no entity-by-clause product is ever made.
    """
    model = clause_model(values, terms)
    whole = model.agg(F.sum(F.col("weight") * F.col("ceiling")).alias("denom"), F.sum(F.col("weight") * F.col("prior")).alias("blank"), F.sum("weight").alias("total_weight"))
    credit = clause_credit(values, terms).join(F.broadcast(model.select("clause", "ceiling", "prior")), "clause")
    own = credit.groupBy("entity").agg(
        F.sum(F.col("weight") * (F.col("credit") - F.col("prior"))).alias("gain"),
        F.sum(F.when(F.col("value") > 0, F.col("weight")).otherwise(0.0)).alias("hold"),
        F.sum("weight").alias("known_weight"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return entities.join(own, "entity", "left").join(F.broadcast(whole)).select("entity", (F.col("blank") + zero("gain")).alias("raw"), "denom", zero("hold").alias("hold"), zero("known_weight").alias("known_weight"), "total_weight")


def final_score(raw: Column, denom: Column, hold: Column, known: Column) -> Column:
    """clamp(raw / denom) * (.25 + .75 (hold + 1) / (known + 2))."""
    mean = F.when(denom > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(raw, denom)))).otherwise(0.0)
    return mean * (0.25 + 0.75 * (hold + 1) / (known + 2))


def score(entities: DataFrame, values: DataFrame, terms: DataFrame) -> DataFrame:
    """(entity, score, mean, conj, coverage) for every entity."""
    p = match_parts(entities, values, terms)
    mean = F.when(F.col("denom") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide("raw", "denom")))).otherwise(0.0)
    conj = 0.25 + 0.75 * (F.col("hold") + 1) / (F.col("known_weight") + 2)
    return p.select("entity", (mean * conj).alias("score"), mean.alias("mean"), conj.alias("conj"), F.try_divide("known_weight", "total_weight").alias("coverage"))


def rescore(saved: DataFrame, clause_rows: DataFrame, ceiling: float, prior: float, weight: float) -> DataFrame:
    """Closed-form score after one more clause, from the saved parts alone.

    ``clause_rows(entity, credit, value)``: entities known on the new clause.
    """
    credit = F.coalesce("credit", F.lit(prior))
    known = F.col("credit").isNotNull()
    hold = F.col("hold") + F.when(known & (F.col("value") > 0), weight).otherwise(0.0)
    return saved.join(clause_rows, "entity", "left").select("entity", final_score(F.col("raw") + weight * credit, F.col("denom") + weight * ceiling, hold, F.col("known_weight") + F.when(known, weight).otherwise(0.0)).alias("score"))


def ranked(scored: DataFrame) -> DataFrame:
    """Best first, ties by entity, with a rank.  The rank needs one order of all rows: for reports."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "entity")))


def clause_state(entities: DataFrame, values: DataFrame, terms: DataFrame) -> DataFrame:
    """(entity, clause, state): yes if a known term holds, no if all terms are known absent, else unknown."""
    clauses = terms.groupBy("clause").agg(F.count("*").alias("terms"))
    known = values.join(F.broadcast(terms), "attr").groupBy("entity", "clause").agg(F.count("*").alias("n"), F.max("value").alias("v"))
    grid = entities.select("entity", F.explode(F.lit([r["clause"] for r in terms.select("clause").distinct().collect()])).alias("clause"))
    state = F.when(F.col("v") > 0, "yes").when(F.col("n") == F.col("terms"), "no").otherwise("unknown")
    return grid.join(known, ["entity", "clause"], "left").join(F.broadcast(clauses), "clause").select("entity", "clause", state.alias("state"))


def answering(states: DataFrame) -> DataFrame:
    """Entities that say yes to every clause."""
    return states.groupBy("entity").agg(F.bool_and(F.col("state") == "yes").alias("a")).where("a").select("entity")


def unread(states: DataFrame) -> DataFrame:
    """Entities without a no, but with an unknown."""
    return states.groupBy("entity").agg((F.bool_and(F.col("state") != "no") & F.bool_or(F.col("state") == "unknown")).alias("u")).where("u").select("entity")


def split_bits(values: DataFrame, weights: DataFrame) -> DataFrame:
    """(attr, q, bits): how much a yes/no question on each attribute splits the weighted field; unknowns count as q.

    n is the inverse-Simpson size of all weights, of those that say yes and of
    those that say no; bits = log2(n / (q n_yes + (1 - q) n_no)), at least 0.
    """
    size = lambda w: F.coalesce(F.try_divide(F.pow(F.sum(w), 2), F.sum(w * w)), F.lit(0.0))
    w = F.col("w")
    per = values.join(weights, "entity").groupBy("attr").agg(
        F.sum(F.when(F.col("value") > 0, w).otherwise(0.0)).alias("yes"), F.sum(w).alias("seen"),
        F.sum(F.when(F.col("value") > 0, w * w).otherwise(0.0)).alias("yes2"), F.sum(w * w).alias("seen2"))
    whole = weights.agg(F.sum("w").alias("all"), F.sum(w * w).alias("all2"), size(w).alias("n"))
    x = per.join(F.broadcast(whole)).withColumn("q", F.coalesce(F.try_divide("yes", "seen"), F.lit(0.0)))
    blind, blind2 = F.col("all") - F.col("seen"), F.col("all2") - F.col("seen2")
    q = F.col("q")
    y, y2 = F.col("yes") + q * blind, F.col("yes2") + q * q * blind2
    n, n2 = F.col("seen") - F.col("yes") + (1 - q) * blind, F.col("seen2") - F.col("yes2") + (1 - q) * (1 - q) * blind2
    left = q * F.coalesce(F.try_divide(y * y, y2), F.lit(0.0)) + (1 - q) * F.coalesce(F.try_divide(n * n, n2), F.lit(0.0))
    bits = F.when((q <= 0) | (q >= 1) | (left <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.log2(F.try_divide("n", left))))
    return x.select("attr", "q", bits.alias("bits"))


def offers(band: DataFrame, values: DataFrame, q: float, spoken: DataFrame, groups: DataFrame, *, near: int = 60) -> DataFrame:
    """(attr, group, yes, no, value, rank): follow-up attributes of the nearest entities.

    yes / no: entities of the band known to have / lack the attribute.  value =
    q yes + (1 - q) no as shares of the band; on a group already spoken of three
    quarters; kept from .08 and 1.5 medians on, two a group, four in all, and only
    if they span two groups.
    """
    head = band.orderBy(F.desc("score"), "entity").limit(near)
    n = F.greatest(F.lit(1), F.col("band_size"))
    x = values.join(head.select("entity"), "entity", "left_semi").groupBy("attr").agg(F.count_if(F.col("value") > 0).alias("yes"), F.count_if(F.col("value") <= 0).alias("no")).join(F.broadcast(head.agg(F.count("*").alias("band_size"))))
    x = x.join(F.broadcast(groups), "attr").join(F.broadcast(spoken.select("group").distinct().withColumn("said", F.lit(True))), "group", "left")
    value = (q * F.col("yes") + (1 - q) * F.col("no")) / n
    x = x.withColumn("value", value).withColumn("rank", F.col("value") * F.when(F.col("said"), 0.75).otherwise(1.0))
    x = x.withColumn("median", F.median("rank").over(Window.partitionBy()))
    x = x.where((F.col("rank") >= 0.08) & (F.col("rank") >= 1.5 * F.col("median")))
    x = x.withColumn("in_group", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("rank"), "attr"))).where("in_group <= 2")
    x = x.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank"), "attr"))).where("place <= 4")
    spread = F.size(F.collect_set("group").over(Window.partitionBy()))
    return x.withColumn("spread", spread).where("spread > 1 OR place = 1").select("attr", "group", "yes", "no", "value", "rank")


def refusal(n_clauses: int, n_marks: int, n_positive: int, denom: float) -> str | None:
    """Why a query can't be answered: no reading, record marks alone, negations alone, or nobody known on any clause."""
    if not n_clauses:
        return "record-only" if n_marks else "no-reading"
    if not n_positive:
        return "negation-only"
    return None if denom > 0 else "no-denominator"


def near_band(scored: DataFrame, size: int = 60) -> DataFrame:
    """Everything at least as good as the ``size``-th score, ties kept."""
    cut = scored.orderBy(F.desc("score")).limit(size).agg(F.min("score").alias("cut"))
    return scored.join(F.broadcast(cut)).where("score >= cut").drop("cut")


def tension(entities: DataFrame, values: DataFrame, terms: DataFrame, *, near: int = 60, churn: float = 0.25, honoured: float = 0.35) -> DataFrame:
    """(clause, churn, honoured, tense): per clause, how much of the band changes without it, and how much of the band has it."""
    top = lambda s: s.orderBy(F.desc(F.round("score", 9)), "entity").limit(near).select("entity")
    head = top(score(entities, values, terms))
    out = None
    for (c,) in sorted((r["clause"],) for r in terms.select("clause").distinct().collect()):  # one query's clauses
        rest = terms.where(F.col("clause") != c)
        without = top(score(entities, values, rest)) if not rest.isEmpty() else head.limit(0)
        own = terms.where(F.col("clause") == c).select("attr")
        held = values.join(F.broadcast(own), "attr", "left_semi").where("value > 0").select("entity").distinct().withColumn("held", F.lit(1))
        row = head.join(without.withColumn("stays", F.lit(1)), "entity", "left").join(held, "entity", "left").agg((1 - F.count("stays") / F.count("*")).alias("churn"), (F.count("held") / F.count("*")).alias("honoured")).withColumn("clause", F.lit(c))
        out = row if out is None else out.unionByName(row)
    return out.select("clause", "churn", "honoured", ((F.col("churn") >= churn) & (F.col("honoured") < honoured)).alias("tense"))


def adaptive_session(entities: DataFrame, values: DataFrame, answers: dict[str, str], *, cap: int = 3, skips: int = 2, min_bits: float = 0.415, showable: int = 240) -> list[dict]:
    """Ask the most informative open attribute, re-weigh by the answer, and stop at the cap, too many skips, too few bits, or few enough left.

    ``answers`` maps an attribute to yes, no or skip.  A driver loop over one
    aggregation a question.
    """
    weights, asked, skipped, log = entities.select("entity", F.lit(1.0).alias("w")), [], 0, []
    while len([x for x in log if x["answer"] != "skip"]) < cap and skipped <= skips:
        open_ = values.where(~F.col("attr").isin(asked)) if asked else values
        best = split_bits(open_, weights).orderBy(F.desc(F.round("bits", 9)), "attr").first()
        if best is None or best["bits"] < min_bits:
            break
        answer = answers.get(best["attr"], "skip")
        asked.append(best["attr"])
        log.append({"attr": best["attr"], "bits": best["bits"], "answer": answer})
        if answer == "skip":
            skipped += 1
            continue
        own = values.where(F.col("attr") == best["attr"]).select("entity", F.col("value").alias("v"))
        fits = F.when(F.col("v").isNull(), best["q"] if answer == "yes" else 1 - best["q"]).when((F.col("v") > 0) == F.lit(answer == "yes"), 1.0).otherwise(0.0)
        weights = weights.join(own, "entity", "left").select("entity", (F.col("w") * fits).alias("w")).where("w > 0")
        if weights.count() <= showable:
            break
    return log
