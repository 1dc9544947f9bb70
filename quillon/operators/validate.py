"""Checks on edges, tags and scores: every check yields rows that say what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The closed vocabularies of edges, and limits on claims and tags.
EDGE_TYPES = ("hand", "descent", "convergence", "rhyme", "answer")
SOURCES = ("record", "attested", "reading")
TRIVIA = ("genre", "genreEra", "countryEra", "cast", "studio")
LEAST_CLAIM, LEAST_BASIS, LEAST_RECALL = 12, 20, 12
TONAL = ("tone", "mood", "warmth", "score", "axes", "fingerprint")


def usable(value: Column, label: Column, *, stop: list[str] = (), vacuous: list[str] = (), vague: str | None = None) -> Column:
    """A value that may be shown: labelled, no stop value, no vacuous or vague label."""
    ok = label.isNotNull() & (F.trim(label) != "")
    if stop:
        ok = ok & ~value.isin(*stop)
    if vacuous:
        ok = ok & ~F.lower(label).isin(*vacuous)
    if vague:
        ok = ok & ~F.lower(label).rlike(vague)
    return F.coalesce(ok, F.lit(False))


def shows_raw_id(claim: Column) -> Column:
    return claim.rlike(r"\bQ\d{4,}\b")


def enough_evidence(text: Column, least: int = 1500) -> Column:
    return F.coalesce(F.length(text) >= least, F.lit(False))


def split_by_vocabulary(clauses: DataFrame, vocabulary: DataFrame, attr: str = "attr") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) clauses by a closed vocabulary."""
    v = vocabulary.select(F.col("attr").alias(attr)).distinct()
    return clauses.join(v, attr, "left_semi"), clauses.join(v, attr, "left_anti")


def tag_reason(roles: list[str], outcomes: list[str], predicates: list[str]) -> Column:
    """Why a tag is rejected: the first rule that it breaks, or null."""
    return (
        F.when(F.col("predicate").isNull() | ~F.col("predicate").isin(*predicates), "unknown predicate")
        .when(F.col("role").isNull() | ~F.col("role").isin(*roles), "unknown role")
        .when(F.col("outcome").isNull() | ~F.col("outcome").isin(*outcomes), "unknown outcome")
        .when(F.col("centrality").isNull() | (F.col("centrality") <= 0) | (F.col("centrality") > 1), "centrality out of range")
        .when(F.length(F.coalesce("basis", F.lit(""))) < LEAST_BASIS, "basis too short")
    )


def validate_tags(tags: DataFrame, roles: list[str], outcomes: list[str], predicates: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Tags with a ``reason`` (null: accepted); of repeats of an entity's predicate the first stands."""
    x = tags.withColumn("reason", tag_reason(roles, outcomes, predicates))
    first = F.row_number().over(Window.partitionBy("entity", "predicate").orderBy(F.col("reason").isNotNull(), ordinal))
    return x.withColumn("reason", F.when(F.col("reason").isNull() & (first > 1), "duplicate").otherwise(F.col("reason")))


def merge_tags(shards: list[DataFrame], roles: list[str], outcomes: list[str], predicates: list[str]) -> DataFrame:
    """Accepted tags of several shards, checked again; an earlier shard wins."""
    every = None
    for i, s in enumerate(shards):
        s = s.withColumn("shard", F.lit(i))
        every = s if every is None else every.unionByName(s)
    x = every.withColumn("place", F.struct("shard", "ordinal"))
    return validate_tags(x, roles, outcomes, predicates, "place").where("reason IS NULL").drop("reason", "place")


def normalise_reply(attrs: Column, recall: Column, tier: Column, vocabulary: list[str]) -> tuple[Column, Column]:
    """(attributes, tier) of a model's reply: known ids only, strengths cut to 0..1, zeros dropped; without a recall of twelve characters the tier is at best ``thin``."""
    clean = F.map_filter(F.transform_values(F.map_filter(attrs, lambda k, v: k.isin(vocabulary) & v.isNotNull()), lambda k, v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))), lambda k, v: v > 0)
    short = F.length(F.coalesce(F.trim(recall), F.lit(""))) < LEAST_RECALL
    return clean, F.when(short & (tier == "known"), "thin").otherwise(tier)


def normalise_axis(value: Column, basis: Column, most: int = 200) -> Column:
    """Struct (score, basis): a whole number in 0..100 with halves up, null where it isn't a number; the basis cut."""
    x = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(x + 0.5)))
    return F.struct(F.when(x.isNotNull(), score).cast("int").alias("score"), F.substring(basis, 1, most).alias("basis"))


def edge_violations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(pair, rule) of every rule that an edge breaks, and of pairs with two edges."""
    known = entities.select(F.col("entity").alias("_e"), F.lit(True).alias("_ok")).distinct()
    side = lambda df, c: df.join(known.withColumnRenamed("_e", c).withColumnRenamed("_ok", f"_{c}"), c, "left")
    x = side(side(edges, "a"), "b").withColumn("pair", F.concat_ws("|", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string")))
    rules = [
        ("endpoint", F.col("_a").isNull() | F.col("_b").isNull()),
        ("self edge", F.col("a") == F.col("b")),
        ("type", ~F.col("type").isin(*EDGE_TYPES)),
        ("source", ~F.col("source").isin(*SOURCES)),
        ("strength", F.col("strength").isNull() | (F.col("strength") <= 0) | (F.col("strength") > 1)),
        ("claim", F.length(F.coalesce("claim", F.lit(""))) < LEAST_CLAIM),
        ("confidence", (F.col("source") == "reading") & (F.coalesce("confidence", F.lit(1.0)) >= 1.0)),
        ("evidence", (F.col("source") == "record") & (F.coalesce(F.size("evidence"), F.lit(0)) < 1)),
        ("raw id", shows_raw_id(F.col("claim"))),
    ]
    broken = x.select("pair", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules)))).alias("rule"))
    twice = x.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1").select("pair", F.lit("two edges").alias("rule"))
    return broken.unionByName(twice)


def is_trivia(signal: Column) -> Column:
    return F.coalesce(signal.isin(*TRIVIA), F.lit(False))


def strip_trivia(also: Column) -> Column:
    """Alternates of an edge without trivia."""
    return F.filter(also, lambda x: ~is_trivia(x["signal"]))


def assert_no_tonal_input(columns: list[str]) -> None:
    """Raises where a table that scores are made of has a tonal column."""
    odd = sorted(c for c in columns if c.lower().split(":")[0] in TONAL)
    if odd:
        raise ValueError(f"tonal input: {odd}")


def licence_of(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(r"public domain|\bpd\b|cc0"), "public").when(t.rlike(r"cc[- ]by"), "cc").when(t.rlike(r"fair use|non-free"), "fair").otherwise("unknown")


def shape_of(width: Column, height: Column) -> Column:
    r = F.try_divide(width.cast("double"), height.cast("double"))
    return F.when(r.isNull(), "unknown").when(r < 0.9, "portrait").when(r <= 1.1, "square").otherwise("landscape")


def collapse_ratio(edges: DataFrame, places: int = 2) -> DataFrame:
    """(share): of the most common strength, to two decimals."""
    return edges.groupBy(F.round("strength", places).alias("s")).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("share"))


def claim_candidates(claims: DataFrame, kind: str, wanted: str = "Q_FILM") -> DataFrame:
    """Entities with a best-rank claim of the wanted kind: deprecated claims never count, preferred ones shut out normal ones."""
    live = claims.where("rank <> 'deprecated'").where(F.col("property") == kind)
    best = live.withColumn("top", F.max(F.when(F.col("rank") == "preferred", 1).otherwise(0)).over(Window.partitionBy("entity"))).where("top = 0 OR rank = 'preferred'")
    return best.where(F.col("value") == wanted).select("entity").distinct()


def nearest_year(wanted: DataFrame, candidates: DataFrame, tolerance: int = 1) -> DataFrame:
    """(key, entity): same title, the year exactly, else within the tolerance; ties by tier, then the lower number; nothing else.

    Years are whole numbers.  Each title and year has one best candidate, which is found
    before the wanted rows join it, so that no row meets all candidates of its title.
    """
    rank = lambda off: F.struct(off.alias("off"), "tier", "entity")
    best = candidates.groupBy("title", "candidate_year").agg(F.min(F.struct("tier", "entity")).alias("c")).select("title", "candidate_year", "c.*")
    near = best.withColumn("step", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance)))).groupBy("title", (F.col("candidate_year") + F.col("step")).alias("year")).agg(F.min(rank(F.col("step") != 0)).alias("c"))
    return wanted.join(near, ["title", "year"]).groupBy("key").agg(F.min("c").alias("c")).select("key", F.col("c.entity").alias("entity"))


def verified_match(a_title: Column, b_title: Column, a_year: Column, b_year: Column) -> Column:
    """exact, near (title and a year off), title (title alone, where one year is unknown), or null."""
    same = a_title == b_title
    gap = F.abs(a_year - b_year)
    return F.when(same & (gap == 0), "exact").when(same & (gap <= 1), "near").when(same & gap.isNull(), "title")


def apply_changes(log: DataFrame, key: str, order: str, op: str = "op") -> DataFrame:
    """The rows that stand after a log of numbered changes: the last of each key, unless it deletes."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("x")).select(key, "x.*")
    return last.where(F.col(op) != "delete").drop(op)
