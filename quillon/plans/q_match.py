"""Three-valued matching queries over documents and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import match as m
from quillon.plans import analogue as an
from quillon.plans.registry import query

CLAUSES = [m.Clause(("quality",), 1.0), m.Clause(("toxic",), 1.0, negate=True)]
THREE = [m.Clause(("quality", "long"), 1.5), m.Clause(("toxic",), 1.0, negate=True), m.Clause(("terse",), 0.6)]

MODEL_SQL = an.VALUE_SQL + """,
vals AS (SELECT * FROM attr_value UNION ALL SELECT entity, 'not:' || attr, 1.0 - value FROM attr_value),
known AS (SELECT attr, count(*) AS k FROM vals GROUP BY attr),
sig AS (SELECT a.entity, a.attr, a.value, CASE WHEN a.value > 0 THEN -log10(((SELECT count(*) FROM vals b WHERE b.attr = a.attr AND b.value >= a.value) + 0.5) / (k + 0.5)) ELSE 0 END AS sigma FROM vals a JOIN known USING (attr)),
model AS (SELECT attr, count(*) AS known, max(value) AS max_value, avg(sigma) AS prior, max(sigma) AS sigma_max, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS prevalence FROM sig GROUP BY attr)"""


def _terms_sql(clauses) -> str:
    rows = ", ".join(f"({i}, {c.weight}, {p}, '{'not:' if c.negate else ''}{a}')" for i, c in enumerate(clauses) for p, a in enumerate(c.any_of))
    return f"terms(clause, weight, pos, attr) AS (VALUES {rows})"


def _score_sql(clauses) -> str:
    return f"""{MODEL_SQL}, {_terms_sql(clauses)},
cm AS (SELECT clause, weight, coalesce(max(sigma_max), 0) AS ceiling, coalesce(max(prior), 0) AS prior FROM terms LEFT JOIN model USING (attr) GROUP BY clause, weight),
grid AS (SELECT entity, clause, weight, ceiling, prior FROM (SELECT DISTINCT doc_id AS entity FROM documents) CROSS JOIN cm),
cred AS (SELECT g.entity, g.clause, g.weight, g.ceiling, g.prior, max(s.sigma) AS credit, max(s.value) AS v FROM grid g LEFT JOIN terms t ON t.clause = g.clause LEFT JOIN sig s ON s.entity = g.entity AND s.attr = t.attr GROUP BY ALL),
parts AS (SELECT entity, sum(weight * coalesce(credit, prior)) / sum(weight * ceiling) AS m, sum(CASE WHEN v > 0 THEN weight ELSE 0 END) AS hold, sum(CASE WHEN v IS NOT NULL THEN weight ELSE 0 END) AS kw, sum(weight) AS tw FROM cred GROUP BY entity)"""


SCORE_SELECT = "SELECT entity, round(greatest(0.0, least(1.0, m)) * (0.25 + 0.75 * (hold + 1) / (kw + 2)), 6) AS score, round(kw / tw, 6) AS coverage"


def _inputs(spark, sf, clauses):
    return an.documents_universe(spark, sf), m.with_complements(an.attr_value(spark, sf)), m.clause_terms(spark, clauses)


@query("match_quality_not_toxic", "A07 A08 A09 A10 A11 A12 Q06 Q07 K02 F20", f"""WITH {_score_sql(CLAUSES)}, s AS ({SCORE_SELECT} FROM parts)
SELECT entity AS doc_id, score, coverage, row_number() OVER (ORDER BY score DESC, entity) AS rank FROM s""")
def match_quality_not_toxic(spark, sf):
    """Documents of high quality that are not toxic, best first; unlabelled documents keep a place."""
    s = m.score(*_inputs(spark, sf, CLAUSES))
    s = s.select("entity", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))
    return m.ranked(s).withColumnRenamed("entity", "doc_id")


@query("match_three_clauses", "A09 A10 A11 A12 Q06", f"WITH {_score_sql(THREE)} {SCORE_SELECT} FROM parts")
def match_three_clauses(spark, sf):
    s = m.score(*_inputs(spark, sf, THREE))
    return s.select("entity", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


@query("attribute_model", "A07 A08 Q07", f"WITH {MODEL_SQL} SELECT attr, known, max_value, round(prior, 6) AS prior, round(sigma_max, 6) AS sigma_max, round(prevalence, 6) AS prevalence FROM model")
def attribute_model(spark, sf):
    x = m.attribute_model(m.with_complements(an.attr_value(spark, sf)))
    return x.select("attr", "known", "max_value", *(F.round(c, 6).alias(c) for c in ("prior", "sigma_max", "prevalence")))


@query("best_term", "A09", f"""WITH {MODEL_SQL}, {_terms_sql(THREE)},
r AS (SELECT s.entity, t.clause, t.attr, s.value, s.sigma, row_number() OVER (PARTITION BY s.entity, t.clause ORDER BY round(s.sigma, 12) DESC, s.value DESC, t.pos) AS rn FROM sig s JOIN terms t USING (attr))
SELECT entity, clause, attr, round(sigma, 6) AS credit FROM r WHERE rn = 1""")
def best_term(spark, sf):
    _, values, terms = _inputs(spark, sf, THREE)
    return m.clause_credit(values, terms).select("entity", "clause", "attr", F.round("credit", 6).alias("credit"))


STATE_SQL = f"""{an.VALUE_SQL},
vals AS (SELECT * FROM attr_value UNION ALL SELECT entity, 'not:' || attr, 1.0 - value FROM attr_value), {_terms_sql(THREE)},
st AS (SELECT d.entity, t.clause, max(v.value) AS v, count(v.value) AS n, count(*) AS terms FROM (SELECT DISTINCT doc_id AS entity FROM documents) d CROSS JOIN terms t LEFT JOIN vals v ON v.entity = d.entity AND v.attr = t.attr GROUP BY d.entity, t.clause),
state AS (SELECT entity, clause, CASE WHEN v > 0 THEN 'yes' WHEN n = terms THEN 'no' ELSE 'unknown' END AS state FROM st)"""


@query("clause_states", "F20", f"WITH {STATE_SQL} SELECT clause, state, count(*) AS n FROM state GROUP BY clause, state")
def clause_states(spark, sf):
    return m.clause_state(*_inputs(spark, sf, THREE)).groupBy("clause", "state").agg(F.count("*").alias("n"))


@query("answering_set", "F21", f"WITH {STATE_SQL} SELECT entity FROM state GROUP BY entity HAVING bool_and(state = 'yes')")
def answering_set(spark, sf):
    return m.answering(m.clause_state(*_inputs(spark, sf, THREE)))


@query("unread_set", "F22", f"WITH {STATE_SQL} SELECT entity FROM state GROUP BY entity HAVING bool_and(state <> 'no') AND bool_or(state = 'unknown')")
def unread_set(spark, sf):
    return m.unread(m.clause_state(*_inputs(spark, sf, THREE)))


@query("incremental_rescore", "Q11", f"WITH {_score_sql(THREE)}, s AS ({SCORE_SELECT} FROM parts) SELECT entity, score FROM s")
def incremental_rescore(spark, sf):
    """The third clause added in closed form to the saved parts of the first two: equal to scoring all three."""
    entities, values, _ = _inputs(spark, sf, THREE)
    saved = m.match_parts(entities, values, m.clause_terms(spark, THREE[:2]))
    last = m.clause_terms(spark, THREE[2:])
    model = m.clause_model(values, last).first()
    rows = m.clause_credit(values, last).select("entity", "credit", "value")
    return m.rescore(saved, rows, model["ceiling"], model["prior"], THREE[2].weight).select("entity", F.round("score", 6).alias("score"))


@query("split_bits", "A13 A14", f"""WITH {an.VALUE_SQL}, w AS (SELECT DISTINCT doc_id AS entity, 1.0 + doc_id % 3 AS w FROM documents),
tot AS (SELECT sum(w) AS t, sum(w * w) AS t2 FROM w),
g AS (SELECT attr, sum(CASE WHEN value > 0 THEN w ELSE 0 END) AS yes, sum(w) AS seen, sum(CASE WHEN value > 0 THEN w * w ELSE 0 END) AS yes2, sum(w * w) AS seen2 FROM attr_value JOIN w USING (entity) GROUP BY attr),
x AS (SELECT attr, yes / seen AS q, yes + yes / seen * (t - seen) AS y, yes2 + (yes / seen) ** 2 * (t2 - seen2) AS y2, seen - yes + (1 - yes / seen) * (t - seen) AS n, seen2 - yes2 + (1 - yes / seen) ** 2 * (t2 - seen2) AS n2, t * t / t2 AS size FROM g CROSS JOIN tot)
SELECT attr, round(q, 6) AS q, round(CASE WHEN q <= 0 OR q >= 1 THEN 0.0 ELSE greatest(0.0, log2(size / (q * y * y / y2 + (1 - q) * n * n / n2))) END, 6) AS bits FROM x""")
def split_bits(spark, sf):
    weights = an.documents_universe(spark, sf).select("entity", (1.0 + F.col("entity") % 3).alias("w"))
    return m.split_bits(an.attr_value(spark, sf), weights).select("attr", F.round("q", 6).alias("q"), F.round("bits", 6).alias("bits"))


@query("effective_size", "A13", "SELECT lang, round(sum(n_chars) * 1.0 * sum(n_chars) / sum(CAST(n_chars AS DOUBLE) * n_chars), 6) AS size FROM documents GROUP BY lang")
def effective_size(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("w", F.col("n_chars").cast("double"))
    return d.groupBy("lang").agg(F.round(F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w")), 6).alias("size"))


@query("near_band", "Q10 K03", f"WITH {_score_sql(CLAUSES)}, s AS ({SCORE_SELECT} FROM parts) SELECT entity, score FROM s WHERE score >= (SELECT score FROM s ORDER BY score DESC LIMIT 1 OFFSET 59)")
def near_band(spark, sf):
    s = m.score(*_inputs(spark, sf, CLAUSES)).select("entity", F.round("score", 6).alias("score"))
    return m.near_band(s).select("entity", "score")


@query("band_diagnostics", "Q10", f"""WITH {_score_sql(CLAUSES)}, s AS ({SCORE_SELECT} FROM parts)
SELECT count(*) AS n, count(CASE WHEN coverage = 0 THEN 1 END) AS blind, count(CASE WHEN coverage < 0.5 THEN 1 END) AS thin, count(CASE WHEN score = (SELECT max(score) FROM s) THEN 1 END) AS tied_at_top FROM s""")
def band_diagnostics(spark, sf):
    s = m.score(*_inputs(spark, sf, CLAUSES)).select(F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))
    top = s.groupBy("score").agg(F.count("*").alias("k"), F.count_if(F.col("coverage") == 0).alias("b"), F.count_if(F.col("coverage") < 0.5).alias("t"))
    return top.agg(F.sum("k").alias("n"), F.sum("b").alias("blind"), F.sum("t").alias("thin"), F.max_by("k", "score").alias("tied_at_top"))


@query("offers", "Q12")
def offers(spark, sf):
    entities, values, terms = _inputs(spark, sf, CLAUSES)
    groups = spark.createDataFrame([(a, g) for a, g in (("quality", "worth"), ("toxic", "worth"), ("long", "size"), ("terse", "size"))], "attr string, group string")
    return m.offers(m.score(entities, values, terms), an.attr_value(spark, sf), 0.5, groups.where("attr = 'quality'"), groups)


@query("tension", "Q13")
def tension(spark, sf):
    return m.tension(*_inputs(spark, sf, THREE))


@query("adaptive_questions", "Q14 A14")
def adaptive_questions(spark, sf):
    log = m.adaptive_session(an.documents_universe(spark, sf), an.attr_value(spark, sf), {"toxic": "no", "long": "yes"})
    return spark.createDataFrame([(i, x["attr"], round(x["bits"], 6), x["answer"]) for i, x in enumerate(log)], "step int, attr string, bits double, answer string")


@query("refusals", "Q09 F05")
def refusals(spark, sf):
    """Status of four queries: answerable, record marks alone, negations alone, nobody known."""
    cases = [("answerable", m.refusal(2, 0, 1, 1.0)), ("marks", m.refusal(0, 2, 0, 0.0)), ("negations", m.refusal(1, 0, 0, 1.0)), ("blind", m.refusal(1, 0, 1, 0.0)), ("nothing", m.refusal(0, 0, 0, 0.0))]
    return spark.createDataFrame(cases, "query string, refusal string")
