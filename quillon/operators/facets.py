"""Facets, postings, permanent identities, versions and their integrity checks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def permanent_id(qid: Column, prefix: str = "film-", namespace: str = "wikidata:") -> Column:
    """Prefix and the first 16 hex digits of sha256(namespace + qid)."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(namespace), qid), 256), 1, 16))


def era_of(year: Column) -> Column:
    """Decade label; ``era:unknown`` where the year is null."""
    return F.when(year.isNull(), F.lit("era:unknown")).otherwise(F.concat(F.lit("era:"), (F.floor(year / 10) * 10).cast("string"), F.lit("s")))


def bucket_of(value: Column, rules: list[tuple[str, list]], default: str) -> Column:
    """First rule whose list holds the value (precedence by position)."""
    out = F.lit(default)
    for name, members in reversed(rules):
        out = F.when(value.isin(members), F.lit(name)).otherwise(out)
    return out


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)))
    return F.lit(value).cast(kind)


def range_bounds(entities: DataFrame, id_col: str) -> list[Column]:
    """Literals that part a table's ids into about equal ranges, as many as shuffle partitions (256 at most): quantiles of the ids of least hash."""
    n = min(256, int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = entities.select(F.col(id_col).alias("id")).where("id IS NOT NULL").orderBy(F.xxhash64("id")).limit(40 * n)
    ids = [r[0] for r in some.distinct().orderBy("id").collect()]
    return [_literal(ids[k], some.schema[0].dataType) for k in sorted({len(ids) * k // n for k in range(1, n)} - {0})]


def range_of(value: Column, bounds: list[Column], first: int = 0) -> Column:
    """How many of the sorted bounds are at most the value; nulls are in the last range."""
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(value < bounds[m], range_of(value, bounds[:m], first)).otherwise(range_of(value, bounds[m + 1 :], first + m + 1))


def row_numbers(entities: DataFrame, id_col: str = "id") -> DataFrame:
    """Entities with ``row``, their place by permanent id, nulls last.  One order of all ids: dealt by range, so that only counts meet in one place.

    The bounds of the ranges are fixed values of the plan, so that rows and counts agree whenever, wherever and
    however often they are read; where the bounds lie changes no place.
    """
    spread = entities.withColumn("_p", range_of(F.col(id_col), range_bounds(entities, id_col)))
    within = spread.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(F.asc_nulls_last(id_col))))
    counts = spread.groupBy("_p").agg(F.count("*").alias("_c"))
    start = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return within.join(F.broadcast(start), "_p").withColumn("row", (F.col("_s") + F.col("_i") - 1).cast("int")).drop("_p", "_i", "_s")


def postings(facets: DataFrame) -> DataFrame:
    """(facet, value, rows): sorted distinct row numbers, from (facet, value, row)."""
    return facets.groupBy("facet", "value").agg(F.array_sort(F.collect_set("row")).alias("rows"))


def posting_counts(facets: DataFrame) -> DataFrame:
    return facets.groupBy("facet", "value").agg(F.count_distinct("row").alias("n"))


def coverage(entities: DataFrame, facets: DataFrame, unknown: str = "unknown") -> DataFrame:
    """(facet, known, unknown, total): an entity is known on a facet if any of its values isn't the unknown mark; with null values alone it is neither."""
    total = entities.agg(F.count_distinct("row").alias("total"))
    each = facets.groupBy("facet", "row").agg(F.max(~F.col("value").endswith(unknown)).alias("known"))
    n = each.groupBy("facet").agg(F.count_if("known").alias("known"), F.count_if(F.col("known").isNull()).alias("null"))
    return n.join(F.broadcast(total)).select("facet", "known", (F.col("total") - F.col("known") - F.col("null")).alias("unknown"), "total")


def provenance(routes: DataFrame) -> DataFrame:
    """(id, value, routes): every way in which an entity got a value, sorted."""
    return routes.groupBy("id", "value").agg(F.array_sort(F.collect_set("route")).alias("routes"))


def delta_encode(posting: DataFrame) -> DataFrame:
    """(facet, value, deltas): first row number, then differences."""
    d = F.transform("rows", lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at("rows", F.greatest(i, F.lit(1)))))
    return posting.select("facet", "value", d.alias("deltas"))


def delta_decode(encoded: DataFrame) -> DataFrame:
    """Running sums of the differences, summed as rows: an array that grows by one a step would be copied each time."""
    steps = encoded.select("facet", "value", F.posexplode_outer("deltas").alias("i", "d"))
    w = Window.partitionBy("facet", "value").orderBy("i")
    at = steps.withColumn("row", F.sum("d").over(w).cast("int"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "row"))))
    return at.groupBy("facet", "value").agg(F.transform(ordered, lambda x: x["row"]).alias("rows"))


def delta_rows(facets: DataFrame) -> DataFrame:
    """The same code on long rows: (facet, value, row, delta) by ``lag``, for postings of any length."""
    w = Window.partitionBy("facet", "value").orderBy("row")
    return facets.select("facet", "value", "row").distinct().withColumn("delta", F.col("row") - F.coalesce(F.lag("row").over(w), F.lit(0)))


def project(posting: DataFrame, kept: DataFrame) -> DataFrame:
    """Postings of a subset, re-indexed to ``kept(row, new_row)``; values that nobody has any more go."""
    return postings(posting.select("facet", "value", F.explode("rows").alias("row")).join(kept, "row").select("facet", "value", F.col("new_row").alias("row")))


def attach_identity(entities: DataFrame, identities: DataFrame) -> DataFrame:
    """Permanent id by qid, else by alias slug; raises where an entity has neither."""
    by_qid = identities.select(F.col("qid").alias("_q"), F.col("id").alias("_by_qid"))
    by_slug = identities.select(F.explode("aliases").alias("_s"), F.col("id").alias("_by_slug"))
    out = entities.join(by_qid, F.col("qid") == F.col("_q"), "left").join(by_slug, F.col("slug") == F.col("_s"), "left")
    found = F.coalesce("_by_qid", "_by_slug")
    return out.withColumn("id", F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no identity for "), F.col("slug"))))).drop("_q", "_s", "_by_qid", "_by_slug")


def select_identities(identities: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id) of keys given as permanent ids or slugs; raises where two keys name one identity."""
    slugs = identities.select("id", F.explode(F.concat(F.array("id"), "aliases")).alias("key")).distinct()
    found = keys.join(slugs, "key")
    times = F.count("*").over(Window.partitionBy("id"))
    return found.withColumn("_n", times).withColumn("id", F.when(F.col("_n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("chosen twice: "), F.col("id"))))).select("key", "id")


def identity_violations(identities: DataFrame) -> DataFrame:
    """(rule, key) of ids, qids and aliases that aren't unique, and aliases that are another's id."""
    dup = lambda df, c, rule: df.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key"))
    alias = identities.select("id", F.explode("aliases").alias("alias")).distinct()
    cross = alias.join(identities.select(F.col("id").alias("other")), F.col("alias") == F.col("other")).where("id <> other").select(F.lit("alias is an id").alias("rule"), F.col("alias").alias("key"))
    return dup(identities, "id", "id").unionByName(dup(identities, "qid", "qid")).unionByName(dup(alias, "alias", "alias")).unionByName(cross)


def facet_violations(posting: DataFrame, entities: DataFrame, counts: DataFrame) -> DataFrame:
    """(rule, facet, value): rows out of range, not sorted or repeated, counts that differ, empty postings."""
    n = entities.agg(F.count("*").alias("n"))
    x = posting.join(F.broadcast(n)).join(counts.select("facet", "value", F.col("n").alias("declared")), ["facet", "value"], "full")
    checks = [
        ("range", F.exists("rows", lambda r: (r < 0) | (r >= F.col("n")))),
        ("order", F.col("rows") != F.array_sort(F.array_distinct("rows"))),
        ("count", F.size("rows") != F.col("declared")),
        ("missing", F.col("rows").isNull()),
        ("undeclared", F.col("declared").isNull()),
        ("empty", F.size("rows") == 0),
    ]
    return x.select("facet", "value", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in checks)))).alias("rule"))


def unambiguous_names(names: DataFrame) -> DataFrame:
    """(name, entity): names that one entity has at their best rank; ambiguous names are dropped."""
    best = names.groupBy("name").agg(F.min("rank").alias("rank"))
    return names.join(best, ["name", "rank"]).groupBy("name").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity")).where("n = 1").select("name", "entity")


def canonical_json(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_version(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def table_version(df: DataFrame, keys: list[str]) -> str:
    """sha256 over the sorted hashes of a table's rows: the same whatever their order or partitions.  64 characters a bucket reach the driver."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    per = df.select(row.alias("h"), F.substring(row, 1, 2).alias("b")).groupBy("b").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("s"))
    return hashlib.sha256("".join(r["s"] for r in per.orderBy("b").collect()).encode()).hexdigest()


def rule_members(entities: DataFrame, rule: dict) -> Column:
    """Does an entity (with array columns) fit: every ``*_any`` facet overlaps, every group of ``themes_all`` overlaps, ``movement_any`` is another way in; an empty rule fits nobody."""
    tests = [F.arrays_overlap(F.col(k[:-4]), F.lit(v)) for k, v in rule.items() if k.endswith("_any") and k != "movement_any" and v]
    tests += [F.arrays_overlap(F.col("themes"), F.lit(group)) for group in rule.get("themes_all", [])]
    ok = F.lit(bool(tests))
    for t in tests:
        ok = ok & F.coalesce(t, F.lit(False))
    if rule.get("movement_any"):
        ok = ok | F.coalesce(F.arrays_overlap(F.col("movement"), F.lit(rule["movement_any"])), F.lit(False))
    return ok


def gate_registers(members: DataFrame, total: int, *, least: int = 5, most_share: float = 0.5, most_overlap: float = 0.8) -> DataFrame:
    """(register, n, share, overlap, passes) from (register, entity): size, share of all, largest Jaccard with another."""
    n = members.groupBy("register").agg(F.count_distinct("entity").alias("n"))
    pairs = members.alias("x").join(members.select(F.col("register").alias("other"), "entity"), "entity").where("register <> other").groupBy("register", "other").agg(F.count("*").alias("c"))
    j = pairs.join(n, "register").join(n.select(F.col("register").alias("other"), F.col("n").alias("m")), "other").groupBy("register").agg(F.max(F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("overlap"))
    out = n.join(j, "register", "left").select("register", "n", (F.col("n") / float(max(1, total))).alias("share"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
    return out.withColumn("passes", (F.col("n") >= least) & (F.col("share") <= most_share) & (F.col("overlap") <= most_overlap))


def compose_facets(facets: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Rows that have every wanted (facet, value)."""
    keep = F.lit(False)
    for f, v in wanted:
        keep = keep | ((F.col("facet") == f) & (F.col("value") == v))
    return facets.where(keep).groupBy("row").agg(F.count_distinct("facet", "value").alias("n")).where(F.col("n") == len(set(wanted))).select("row")


def compare_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, status): missing, added, moved (same key, other qid), re-keyed (same qid, other key), kept."""
    o, n = old.select("key", F.col("qid").alias("oq")), new.select("key", F.col("qid").alias("nq"))
    by_key = o.join(n, "key", "full")
    keys = new.select(F.col("key").alias("now"), F.col("qid").alias("q"))
    gone = by_key.where("nq IS NULL").join(keys, F.col("oq") == F.col("q"), "left").select("key", F.when(F.col("now").isNotNull(), "re-keyed").otherwise("missing").alias("status"))
    same = by_key.where("nq IS NOT NULL").select("key", F.when(F.col("oq").isNull(), "added").when(F.col("oq") != F.col("nq"), "moved").otherwise("kept").alias("status"))
    return gone.unionByName(same)


def lookup_stages(names: DataFrame, wanted: str, most: int = 10) -> DataFrame:
    """(name, stage, entity): exact matches, then prefixes, then names that contain the words."""
    stage = F.when(F.col("name") == wanted, 0).when(F.col("name").startswith(wanted), 1).when(F.col("name").contains(wanted), 2)
    return names.withColumn("stage", stage).where("stage IS NOT NULL").orderBy("stage", "name", "entity").limit(most).select("name", "stage", "entity")


def suggestions(names: DataFrame, typed: str, starts: int = 4, total: int = 6) -> DataFrame:
    """At most ``starts`` names that start with what is typed, then others that contain it, ``total`` in all."""
    x = names.where(F.col("name").contains(typed)).withColumn("late", F.when(F.col("name").startswith(typed), 0).otherwise(1))
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("late").orderBy("name", "entity"))).where((F.col("late") == 1) | (F.col("i") <= starts))
    return x.orderBy("late", "i").limit(total).select("name", "entity")
