"""Prose guards: why an essay, or a sentence of it, may not speak of a work.

Essays (one row a post and film) are refused, or held to sentences that name the
film, before their sentences are read; sentences are dropped by the first guard
that they trip, with drop counters.  Some guards say that a sentence speaks of
something else; a sentence right behind it that opens with a plural pointer
("These characters ...") still does, and so do further ones.  That carry is a
running maximum over runs of sentences, not a loop.

Nulls: a null text is an empty one (dropped as too short); null arrays of names
are empty.  Names come from tables and are found by equi-joins on words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx

# Lengths, counts and patterns of the guards; the last column of SENTENCE_PATTERNS says whether the sentence speaks of something else.
SHORTEST, LONGEST = 40, 700
LEAST_TITLE, LEAST_OTHER_TITLE, LEAST_MENTIONS, LEAST_RIVAL = 3, 4, 3, 3
ENDED = r"[.!?…][\"”’)]?\s*$"
POINTER = r"^[\"“‘']?(These|Those|They|Such|Both|All (?:three|four)|This group)\b"
FIRST_PERSON = r"(?i)^[\"“‘']?(when\s+)?i\b"
CITATION = r"(?i)\b(argu(?:es|ed|ing)|according to|et al|as [A-Z]\w+(?: [A-Z]\w+)? (?:has |have )?(?:says?|said|writes?|wrote|notes?|noted|puts?|argues?|argued|observes?|observed)|for [A-Z][\w’']+,\s|(?:s?he|they) (?:argues|writes|says|notes|claims|suggests)|identifi(?:es|ed)|characteris(?:es|ed)|characteriz(?:es|ed)|defin(?:es|ed|ition)|observ(?:es|ed) that|suggest(?:s|ed) that|claim(?:s|ed) that|writes that|notes that|puts it|assert(?:s|ed)|contend(?:s|ed)|maintain(?:s|ed) that|insist(?:s|ed)|declar(?:es|ed)|remark(?:s|ed)|famously|once (?:said|wrote|remarked|observed|called|described)|in the words of|interviews?|described by [A-ZÀ-Þ]\w+ as)\b|\(\s*[A-ZÀ-Þ][a-zà-ÿ]+\s*\)"
LONG_QUOTE = r"[“\"][^”\"]{60,}[”\"]"
THEORY = r"(?i)\b(modernis[mt]|postmodernis\w*|meta-?textual\w*|representation|signifiers?|signifieds?|discourse|dialectic\w*|paradigm|ontolog\w*|epistemolog\w*|phenomenolog\w*|spectatorship|spectators?|a work of art|watching a (?:movie|film)|this model|theor(?:y|ies|ist|ists|etical)|cinema (?:is|can|has|does|itself)|the medium\b|film as (?:an? )?(?:art|form|medium)|(?:all|every|any) (?:great |good |true )?(?:films?|movies?|cinema|art)\b|the seventh art|the (?:language|history|art|grammar) of (?:film|cinema)|the genre\b|genre conventions?|by definition|films? in general|panoptic\w*)\b"
COMPARATIVE = r"(?i)\b(unlike|as opposed to|in contrast (?:to|with)|by contrast with|whereas|compared (?:to|with)|in comparison (?:to|with)|the original\b|remakes?|remade|reworking of|the \d{4} (?:version|film|original))\b"
GENERIC = r"(?i)\bfilms that\b|\btends? to be\b|\bmany (?:directors|filmmakers|films|movies)\b|\bso-called\b|\bare often\b|\bis often (?:depicted|described|seen|said)\b|\bthe novel\b|\bexpect(?:ing|s)?\b[^.;]*\bdisappoint|\bI (?:had|was|did|am|have|will|would|could)\b|\b(?:Academy Award|Oscar|Palme d[’']Or|Golden (?:Lion|Bear|Globe)|BAFTA|C[ée]sar)\b|\bsuch (?:elements|devices|strategies|techniques) as\b|\bsynonymous with\b|\bas an? \w+ (?:aesthetic|mode|form|genre|tradition)\b|\bimperative\b"
OEUVRE = r"(?i)\b(earlier|previous|later|subsequent|next|other|another|preceding|prior)\s+(?:[A-ZÀ-Þ][\w’'-]+\s+)?(films?|features?|works?|pictures?|movies?|efforts?|projects?|protagonists?|heroes|heroines)\b|\b(his|her|their|whose|the director[’']s?)\s+(?:\w+\s+)?(work|works|films|movies|oeuvre|œuvre|filmography|careers?|adaptations?|body of work)\b|\b(?:better|best|lesser|less|least|most)[- ]known\s+(?:films?|works?|movies?)\b|\ba (?:series|string|succession) of\b[^.;]{0,60}\b(?:projects|films|works|pictures)\b"
POSSESSIVE_WORK = r"\b([A-ZÀ-Þ][a-zà-ÿ’'-]+)[’']s\s+(work|films|movies|works|oeuvre|œuvre|filmography|career|cinema|voice|style|approach|aesthetics?|camera|documentaries|narration|body of work)\b"
WHOLE_WORK = r"(?i)^(work|films|movies|works|oeuvre|œuvre|filmography|career|body of work)$"
POSSESSIVE_TITLE = r"\b([A-ZÀ-Þ][a-zà-ÿ’'-]{2,})[’']s?\s"
SURNAME = r"\b([A-ZÀ-Þ][a-zà-ÿ’'-]{3,})\b"
CREDIT = r"([A-ZÀ-Þ][A-Za-zà-ÿ.’'-]{2,})[’']s?\s+(?:(?:18|19|20)\d\d\s+)?(?:film\s+|movie\s+|version(?:\s+of)?\s+|remake(?:\s+of)?\s+|adaptation(?:\s+of)?\s+|original\s+)?"
DATED = r"\s*\(\s*((?:18|19|20)\d\d)"
OPEN_MARK, CLOSE_MARK = "⟦", "⟧"
OFF_FILM = ("comparative", "generic", "possessive", "italic", "other film", "other hand", "oeuvre")


def _names(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, "[’']s?$", "")


def _pairs(c: Column, pattern: Column) -> Column:
    """The two groups of each match, as ``a`` and ``b``."""
    return F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("b"))


def _is_own(name: Column) -> Column:
    """A hand of the film, or a word of one of its titles."""
    words = F.flatten(F.transform(_names("titles"), lambda t: F.split(t, " ")))
    return F.array_contains(_names("hands"), name) | F.array_contains(words, tx.fold(name))


def _names_one(folded: Column, titles: Column, least: int) -> Column:
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    return F.exists(titles, lambda t: (F.length(t) >= least) & F.contains(padded, F.concat(F.lit(" "), t, F.lit(" "))))


def surnames_in(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(SURNAME), F.lit(1)), _bare)


def foreign_hands(texts: DataFrame, keys: list[str], names: Column, surnames: DataFrame) -> DataFrame:
    """(keys, name, n): how often a text has a surname of the catalogue that is no hand of its film."""
    found = texts.select(*keys, F.explode(F.filter(names, lambda n: ~F.array_contains(_names("hands"), n))).alias("name"))
    n = found.groupBy(*keys, "name").agg(F.count("*").alias("n"))
    return n.join(surnames.select("name").distinct(), "name", "left_semi")


def judge_essays(essays: DataFrame, surnames: DataFrame) -> DataFrame:
    """Essays with ``reason`` (null: usable) and ``must_name`` (only sentences that name the film count).

    ``essays``: post, film, title, text, year, about, about_many, titles (folded),
    hands (surnames); one row a post and film.  ``surnames``: name, film.
    """
    keys, text = ["post", "film"], F.coalesce("text", F.lit(""))
    long = F.filter(_names("hands"), lambda h: F.length(h) >= 4)
    no_hand = (F.size(long) > 0) & ~F.exists(long, lambda h: F.contains(tx.fold(text), tx.fold(h)))
    credited = F.exists(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(POSSESSIVE_TITLE), F.lit(1)), lambda n: ~_is_own(n))
    titles = F.filter(_names("titles"), lambda t: F.length(t) >= LEAST_TITLE)
    written = lambda t: F.concat(F.lit(r"\b((?i:"), F.replace(t, F.lit(" "), F.lit("[^A-Za-z0-9]{1,3}")), F.lit(r"))\b"))
    dated = F.exists(F.flatten(F.transform(titles, lambda t: _pairs(text, F.concat(written(t), F.lit(DATED))))), lambda x: x["a"].rlike("[A-ZÀ-Þ]") & (F.abs(x["b"].cast("int") - F.col("year")) > 1))
    credits = F.filter(F.flatten(F.transform(titles, lambda t: _pairs(text, F.concat(F.lit(CREDIT), written(t))))), lambda x: x["b"].rlike("[A-ZÀ-Þ]"))
    mentions = F.array_max(F.transform(titles, lambda t: F.size(F.split(F.concat(F.lit(" "), F.replace(tx.fold(text), F.lit(" "), F.lit("  ")), F.lit(" ")), F.concat(F.lit(" "), F.replace(t, F.lit(" "), F.lit("  ")), F.lit(" ")))) - 1))

    named = surnames_in(text)
    own = F.coalesce(F.array_max(F.transform(long, lambda h: F.size(F.filter(named, lambda n: n == h)))), F.lit(0))
    rivals = foreign_hands(essays, keys, named, surnames).groupBy(*keys).agg(F.max("n").alias("rival"))
    mine = F.filter(F.transform(credits, lambda x: _bare(x["a"])), lambda n: ~_is_own(n))
    others = foreign_hands(essays, keys, mine, surnames).select(*keys, F.lit(True).alias("remade")).distinct()
    x = essays.join(rivals, keys, "left").join(others, keys, "left")
    reason = F.when(no_hand, "no hand").when(credited, "credited to another").when(F.coalesce(dated, F.lit(False)) | F.col("remade"), "other version").when(~F.coalesce("about", F.lit(False)) & (F.coalesce(mentions, F.lit(0)) < LEAST_MENTIONS), "few mentions")
    rival = F.coalesce((F.col("rival") >= LEAST_RIVAL) & (F.col("rival") >= own), F.lit(False))
    must = ~F.coalesce("about", F.lit(False)) | F.coalesce("about_many", F.lit(False)) | rival
    return x.withColumn("reason", reason).withColumn("must_name", must).drop("rival", "remade")


def _pattern_reason(plain: Column, marked: Column) -> Column:
    """The first guard that a sentence trips, without those for its surroundings."""
    folded = tx.fold(plain)
    times = lambda mark: F.length(plain) - F.length(F.replace(plain, F.lit(mark), F.lit("")))
    credits = _pairs(plain, F.lit(POSSESSIVE_WORK))
    italics = F.transform(F.regexp_extract_all(marked, F.lit(f"{OPEN_MARK}([^{CLOSE_MARK}]*){CLOSE_MARK}"), F.lit(1)), F.trim)
    return (
        F.when(times("“") != times("”"), "citation")
        .when(F.col("must_name") & ~_names_one(folded, _names("titles"), LEAST_TITLE), "not named")
        .when(plain.rlike(FIRST_PERSON), "first person")
        .when(plain.rlike(CITATION) | plain.rlike(LONG_QUOTE), "citation")
        .when(plain.rlike(THEORY), "theory")
        .when(plain.rlike(COMPARATIVE), "comparative")
        .when(plain.rlike(GENERIC), "generic")
        .when(F.exists(credits, lambda x: ~_is_own(x["a"]) | (F.array_contains(_names("hands"), x["a"]) & x["b"].rlike(WHOLE_WORK))), "possessive")
        .when(F.exists(italics, lambda i: i.rlike("[A-ZÀ-Þ]") & (F.length(tx.fold(i)) >= LEAST_TITLE) & ~F.array_contains(_names("titles"), tx.fold(i))), "italic")
        .when(_names_one(folded, F.array_except(_names("other_titles"), _names("titles")), LEAST_OTHER_TITLE), "other film")
        .when(F.col("other_hand"), "other hand")
        .when(plain.rlike(OEUVRE), "oeuvre")
    )


def guard_sentences(sentences: DataFrame, surnames: DataFrame) -> DataFrame:
    """Sentences with ``reason``: the first guard that drops them, or null.

    ``sentences``: post, film, pos, text (italics between ``OPEN_MARK`` and
    ``CLOSE_MARK``), must_name, titles, hands, other_titles (folded titles of the
    post's other films).  Places are unique in a post and film.
    """
    keys = ["post", "film", "pos"]
    marked = F.coalesce("text", F.lit(""))
    plain = F.translate(marked, OPEN_MARK + CLOSE_MARK, "")
    strange = foreign_hands(sentences, keys, surnames_in(plain), surnames).select(*keys, F.lit(True).alias("other_hand")).distinct()
    x = sentences.join(strange, keys, "left").withColumn("other_hand", F.coalesce("other_hand", F.lit(False)))
    early = F.when(~F.length(marked).between(SHORTEST, LONGEST), "length").when(~marked.rlike(ENDED), "no sentence").when(F.contains(marked, F.lit("?")), "question")
    x = x.withColumn("early", early).withColumn("own", F.when(F.col("early").isNull(), _pattern_reason(plain, marked))).withColumn("points", plain.rlike(POINTER))
    # A run: a sentence without a pointer, and those with pointers behind it; sentences that were dropped early are no part of it.
    read = Window.partitionBy("post", "film", F.col("early").isNull()).orderBy("pos")
    x = x.withColumn("run", F.sum((~F.col("points")).cast("int")).over(read))
    before = Window.partitionBy("post", "film", F.col("early").isNull(), "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    off = F.max(F.coalesce(F.col("own").isin(*OFF_FILM), F.lit(False))).over(before)
    x = x.withColumn("off", F.coalesce(off, F.lit(False)))
    reason = F.coalesce("early", F.when(F.col("points") & F.col("off"), "pointer"), "own")
    return x.withColumn("reason", reason).drop("early", "own", "points", "run", "off", "other_hand")


def drop_counts(guarded: DataFrame) -> DataFrame:
    return guarded.groupBy(F.coalesce("reason", F.lit("kept")).alias("guard")).agg(F.count("*").alias("n"))
