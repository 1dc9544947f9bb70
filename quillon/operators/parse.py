"""From a plain sentence to weighted clauses.

A sentence is read from left to right: a pointer at a known work (cue, then
title, longest first), then a guarded phrase, then a lexicon phrase, longest
first.  Negation looks back at most four words and degree three, never over a
clause wall or over words that another reading has used.  A family's name right
behind a reading of that family ("a hopeful tone") belongs to it.  What nothing
read is kept as spans with a reason.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx

NEGATION_WINDOW, DEGREE_WINDOW = 4, 3
UP, DOWN = 1.5, 0.6
ARTICLES = ("the", "a", "an")
# The names of attribute families that a reader may add behind a phrase.
NAMESPACES = ("pace", "tone", "mood", "subject", "story", "texture", "structure", "setting", "mode")


@dataclass
class Lexicon:
    """Phrases by folded text, with attribute and polarity; cues, modifiers, guards, stop words."""

    phrases: dict[str, list[tuple[str, str]]]
    negation: set[str]
    up: set[str]
    down: set[str]
    stop: set[str]
    guards: dict[str, tuple[str, str]] = field(default_factory=dict)
    cues: list[tuple[str, str | None]] = field(default_factory=list)  # cue words, group of attributes
    groups: dict[str, list[str]] = field(default_factory=dict)
    neighbours: dict[str, list[str]] = field(default_factory=dict)
    namespaces: set[str] = field(default_factory=lambda: set(NAMESPACES))

    @classmethod
    def build(cls, phrases: dict[str, list], negation, up, down, stop, guards=(), cues=(), groups=None, neighbours=None, namespaces=None) -> Lexicon:
        """Fold all keys; a phrase that holds a negator of its own is ``inherent``: it says an absence by itself."""
        neg = {tx.fold_text(x) for x in negation}
        table: dict[str, list[tuple[str, str]]] = {}
        for attr, items in phrases.items():
            for item in items:
                phrase, polarity = (item, "plain") if isinstance(item, str) else (item["phrase"], item.get("polarity", "plain"))
                key = tx.fold_text(phrase)
                if set(key.split()) & neg:
                    polarity = "inherent"
                table.setdefault(key, []).append((attr, polarity))
        return cls(table, neg, {tx.fold_text(x) for x in up}, {tx.fold_text(x) for x in down}, {tx.fold_text(x) for x in stop}, {tx.fold_text(p): (why, kind) for p, why, kind in guards}, sorted(((tx.fold_text(c), g) for c, g in cues), key=lambda c: -len(c[0].split())), groups or {}, neighbours or {}, set(namespaces or NAMESPACES))


def distinctive(sigma: dict[str, tuple[float, float]], attrs: list[str] | None, most: int) -> list[tuple[str, float, float]]:
    """A work's attributes (attr, strength, surprisal) that it holds, most surprising first; ``most`` 0: all."""
    rows = [(a, s, v) for a, (s, v) in sigma.items() if s > 0 and (attrs is None or a in attrs)]
    rows.sort(key=lambda r: (-r[2], r[0]))
    return rows[:most] if most else rows


@dataclass
class Works:
    """Folded title to work, and each work's attributes: attr to (strength, surprisal)."""

    titles: dict[str, str] = field(default_factory=dict)
    readings: dict[str, dict[str, tuple[float, float]]] = field(default_factory=dict)

    @property
    def longest(self) -> int:
        return max((len(t.split()) for t in self.titles), default=0)


class Sentence:
    """One reading of one sentence."""

    def __init__(self, text: str, lexicon: Lexicon, works: Works | None = None, like_terms: int = 4, group_min: int = 2):
        self.text, self.lex, self.works = text, lexicon, works or Works()
        self.like_terms, self.group_min = like_terms, group_min
        self.tokens = [t for t in tx.tokens_with_offsets(text) if t[0]]
        self.words = [w for w, _, _ in self.tokens]
        self.walls = tx.walls(text, self.tokens)
        self.used = [False] * len(self.tokens)
        self.readings: list[dict] = []
        self.unread: list[dict] = []
        i = 0
        while i < len(self.words):
            i = self._work(i) or self._guard(i) or self._phrase(i) or i + 1
        for reading in self.readings:
            self._family_name(reading)
        self._leftovers()

    def _span(self, i: int, j: int) -> dict:
        start, end = self.tokens[i][1], self.tokens[j - 1][2]
        return {"text": self.text[start:end], "start": start, "end": end}

    def _modifiers(self, i: int) -> tuple[str | None, float, int, str | None]:
        """The negator's and the degree's words, the weight, and where all of them begin."""
        negate, weight, first, degree = None, 1.0, i, None
        for back in range(1, max(NEGATION_WINDOW, DEGREE_WINDOW) + 1):
            p = i - back
            if p < 0 or p + 1 in self.walls or self.used[p]:
                break
            one, two = self.words[p], " ".join(self.words[max(0, p - 1) : p + 1])
            if back <= NEGATION_WINDOW and one in self.lex.negation and not negate:
                negate, first = one, min(first, p)
            if back <= DEGREE_WINDOW and weight == 1.0:
                for value, words in ((UP, self.lex.up), (DOWN, self.lex.down)):
                    if one in words or p and two in words:
                        weight, first, degree = value, min(first, p if one in words else p - 1), one if one in words else two
                        break
        return negate, weight, first, degree

    def _work(self, i: int) -> int | None:
        for cue, group in self.lex.cues:
            n = len(cue.split())
            if " ".join(self.words[i : i + n]) != cue:
                continue
            starts = [i + n] + ([i + n + 1] if i + n < len(self.words) and self.words[i + n] in ARTICLES else [])
            for s in starts:
                for size in range(min(self.works.longest, len(self.words) - s), 0, -1):
                    key = self.works.titles.get(" ".join(self.words[s : s + size]))
                    if key is not None:
                        return self._point(i, s + size, key, group)
        return None

    def _point(self, i: int, j: int, key: str, group: str | None) -> int:
        held, widened = self.works.readings.get(key, {}), False
        if group:
            picked = distinctive(held, self.lex.groups.get(group, []), 0)
            if len(picked) < self.group_min:
                near = [a for g in self.lex.neighbours.get(group, [group]) for a in self.lex.groups.get(g, [])]
                more = [r for r in distinctive(held, near, self.like_terms) if r[0] not in {p[0] for p in picked}]
                picked, widened = picked + more, bool(more)
            picked = picked[: self.like_terms]
        else:
            picked = distinctive(held, None, self.like_terms)
        self.used[i:j] = [True] * (j - i)
        negate, weight, _, degree = self._modifiers(i)
        if not picked:
            self.unread.append({**self._span(i, j), "why": "no reading of this work", "kind": "work-unread"})
        for attr, strength, _ in picked:
            self.readings.append({"kind": "work", **self._span(i, j), "terms": [attr], "negate": bool(negate), "refused": None, "degree": degree, "weight": round(strength * weight, 2), "work": key, "widened": widened})
        return j

    def _family_name(self, reading: dict) -> None:
        families = {attr.split(":")[0] for attr in reading["terms"]}
        for k, (word, start, end) in enumerate(self.tokens):
            if start < reading["end"]:
                continue
            if self.used[k] or word not in self.lex.namespaces or word not in families:
                break
            self.used[k] = True
            reading.update(end=end, text=self.text[reading["start"] : end])

    def _guard(self, i: int) -> int | None:
        longest = max((len(g.split()) for g in self.lex.guards), default=0)
        for size in range(min(longest, len(self.words) - i), 0, -1):
            hit = self.lex.guards.get(" ".join(self.words[i : i + size]))
            if hit:
                self.used[i : i + size] = [True] * size
                self.unread.append({**self._span(i, i + size), "why": hit[0], "kind": hit[1]})
                return i + size
        return None

    def _phrase(self, i: int) -> int | None:
        longest = max((len(p.split()) for p in self.lex.phrases), default=0)
        for size in range(min(longest, len(self.words) - i), 0, -1):
            phrase = " ".join(self.words[i : i + size])
            row = self.lex.phrases.get(phrase)
            if not row and size == 1 and len(phrase) > 3 and phrase.endswith("s"):
                row = self.lex.phrases.get(phrase[:-1])
            if row:
                negate, weight, first, degree = self._modifiers(i)
                inherent = any(p == "inherent" for _, p in row)
                self.used[first : i + size] = [True] * (i + size - first)
                self.readings.append({"kind": "phrase", **self._span(first, i + size), "terms": [a for a, _ in row], "negate": bool(negate) and not inherent, "refused": negate if inherent else None, "degree": degree, "weight": weight, "work": None, "widened": False})
                return i + size
        return None

    def _leftovers(self) -> None:
        """Runs of words that no reading used, unless they are stop words alone."""
        run: list[int] = []
        for k in range(len(self.words) + 1):
            if k < len(self.words) and not self.used[k]:
                run.append(k)
                if k + 1 not in self.walls:
                    continue
            if run and any(self.words[r] not in self.lex.stop for r in run):
                spoken = " ".join(self.words[r] for r in run)
                lost = any(f" {c} " in f" {spoken} " and not spoken.endswith(c) for c, _ in self.lex.cues)
                self.unread.append({**self._span(run[0], run[-1] + 1), "why": "a work that isn't held" if lost else "not in the vocabulary", "kind": "work-missing" if lost else "unknown"})
            run = []

    def clauses(self) -> tuple[list[dict], list[dict]]:
        """Clauses, one for the same terms and sign, with the greatest weight; and conflicts: said and unsaid."""
        out: dict[tuple, dict] = {}
        conflicts = []
        for r in self.readings:
            key = (r["negate"], tuple(r["terms"]))
            if (not r["negate"], key[1]) in out:
                conflicts.append({"terms": list(key[1]), "text": r["text"], "against": out[(not r["negate"], key[1])]["said"]})
            if key in out:
                out[key]["weight"] = max(out[key]["weight"], r["weight"])
            else:
                out[key] = {"any_of": list(key[1]), "weight": r["weight"], "negate": r["negate"], "said": r["text"]}
        return list(out.values()), conflicts


READING = "struct<readings:array<struct<kind:string,text:string,start:int,end:int,terms:array<string>,negate:boolean,refused:string,degree:string,weight:double>>,unread:array<struct<text:string,start:int,end:int,why:string,kind:string>>,clauses:array<struct<any_of:array<string>,weight:double,negate:boolean,said:string>>,conflicts:array<struct<terms:array<string>,text:string,against:string>>>"


def parse_sentences(df: DataFrame, column: str, lexicon: Lexicon, works: Works | None = None) -> DataFrame:
    """The table with a ``reading`` struct a row: readings, unread spans, clauses, conflicts.  Arrow-batched."""
    from quillon.operators import parse

    def one(s: str | None) -> str:
        if not s:
            return json.dumps({"readings": [], "unread": [], "clauses": [], "conflicts": []})
        x = parse.Sentence(s, lexicon, works)
        clauses, conflicts = x.clauses()
        return json.dumps({"readings": x.readings, "unread": x.unread, "clauses": clauses, "conflicts": conflicts})

    run = F.pandas_udf(lambda s: s.map(one), "string")
    return df.withColumn("reading", F.from_json(run(F.col(column)), READING))


def clause_rows(parsed: DataFrame, key: str) -> DataFrame:
    """(key, clause, any_of, weight, negate) of parsed sentences."""
    return parsed.select(key, F.posexplode("reading.clauses").alias("clause", "c")).select(key, "clause", "c.any_of", "c.weight", "c.negate")


def record_marks(spans: DataFrame, marks: DataFrame) -> DataFrame:
    """(text, facet, value) of unread spans that name exactly one facet value; names of several are dropped.  They filter, and never score."""
    one = marks.select(tx.fold(F.col("name")).alias("k"), "facet", "value").distinct().groupBy("k").agg(F.count("*").alias("n"), F.first("facet").alias("facet"), F.first("value").alias("value")).where("n = 1")
    return spans.withColumn("k", tx.fold(F.col("text"))).join(one, "k").select("text", "facet", "value")


def accept_interpretation(reply: Column, vocabulary: list[str], most: int = 8, most_unread: int = 12) -> Column:
    """An outside model's clauses, cleaned: known ids only, first of each, weights within .5 to 2, at most ``most``; unread phrases at most ``most_unread``."""
    x = F.from_json(reply, "struct<clauses:array<struct<attr:string,weight:double,negate:boolean>>,unread:array<string>>")
    known = F.filter(F.coalesce(x["clauses"], F.array().cast("array<struct<attr:string,weight:double,negate:boolean>>")), lambda c: c["attr"].isin(vocabulary))
    first = F.filter(F.transform(known, lambda c, i: F.struct(c["attr"].alias("attr"), F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.coalesce(c["weight"], F.lit(1.0)))).alias("weight"), F.coalesce(c["negate"], F.lit(False)).alias("negate"), (F.array_position(F.transform(known, lambda k: k["attr"]), c["attr"]) == i + 1).alias("own"))), lambda c: c["own"])
    clean = F.transform(F.slice(first, 1, most), lambda c: F.struct(c["attr"].alias("attr"), c["weight"].alias("weight"), c["negate"].alias("negate")))
    return F.struct(clean.alias("clauses"), F.slice(F.coalesce(x["unread"], F.array().cast("array<string>")), 1, most_unread).alias("unread"))


def lexicon_matches(df: DataFrame, key: str, column: str, phrases: DataFrame, longest: int) -> DataFrame:
    """(key, start, phrase): every lexicon phrase in a text, the longest at each place, by an equi-join on word n-grams."""
    words = df.select(key, F.filter(F.split(tx.fold(F.col(column)), " "), lambda w: w != "").alias("w"))
    grams = words.select(key, F.posexplode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(i.alias("start"), n.alias("n"), F.concat_ws(" ", F.slice(F.col("w"), i, n)).alias("phrase")))).otherwise(F.array().cast("array<struct<start:int,n:int,phrase:string>>"))))).alias("_", "g")).select(key, "g.*")
    return grams.join(phrases.select("phrase").distinct(), "phrase").groupBy(key, "start").agg(F.max_by("phrase", "n").alias("phrase"))


