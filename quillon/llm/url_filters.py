"""URL filters: host and path rules, and link-graph propagation for what they leave open.

DataFrame functions only.  A rule ``host/path`` fits its host and all
subdomains where the url's path starts with the rule's path; the longest that
fits decides.  For urls without a rule, trust and distrust are propagated over
host edges: personalised PageRank from the hosts of allowed urls along links,
and from the hosts of blocked urls against them (who links to a blocked host is
suspect).  A host's seed is the share of its pages that rules allow or block.
Scores are divided by 1 - damping, so that a host without links keeps its seed;
a host is blocked when its distrust is at least ``threshold`` and above its
trust.

Edges are counted by pair of hosts before anything else, so that a host with a
third of all pages is one row; every round joins (kind, host) scores with
weighted edges and sums partially.  Scores go to the shared folder every few
rounds, until these change no score by more than 1e-10.  Scores are rounded to
nine decimals before they are compared.

Nulls and edges: a null url, or one without ``://``, has an empty host and path
and no rule; it has no seeds either, so that it is allowed.  Null html has no
links; whole pages are searched, however long, in time that grows with their
length.  Repeated rows give as many rows, and their links count each; a null id
is kept.  Of rules that fit the longest wins, of equal ones the last by text;
distrust that equals the threshold blocks, distrust that equals trust doesn't.
Without links no round is run.  An empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.when(url.isNotNull() & (F.instr(url, "://") > 0), F.translate(host, string.ascii_uppercase, string.ascii_lowercase)).otherwise("")


def path_of(url: Column) -> Column:
    found = F.regexp_extract(F.substring(url, F.instr(url, "://") + 3, F.length(url)), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(url.isNotNull() & (F.instr(url, "://") > 0), found).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


# The references by which the characters that part an address may be written.
REFERENCES = {":": "&#0*58;|&#[xX]0*3[aA];|&colon;", "/": "&#0*47;|&#[xX]0*2[fF];|&sol;", ".": "&#0*46;|&#[xX]0*2[eE];|&period;", "&": "&#0*38;|&#[xX]0*26;|&amp;"}


def link_hosts(html: Column) -> Column:
    """Hosts of all absolute links of a page, repeated ones too."""
    links = F.regexp_extract_all(html, F.lit(r"""(?i)(?<![-\w])href\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>"']++)"""), F.lit(1))

    def host(link: Column) -> Column:
        for char, written in REFERENCES.items():
            link = F.regexp_replace(link, written, char)
        link = F.regexp_replace(link, r"""^["']?\s*+|\s++["']?$|["']$""", "")
        return F.when(link.rlike("(?i)^(https?:)?//"), host_of(F.concat(F.lit("http://"), F.regexp_replace(link, "(?i)^(https?:)?//", "")))).otherwise("")

    return F.transform(links, host)


def host_edges(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(src, dst, n): links between different hosts, by absolute address."""
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(link_hosts(F.col(html_col))).alias("dst"))
    return found.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int | None = None, every: int = 5, tolerance: float = 1e-10) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, trust, distrust).

    Rounds go on until ``every`` of them change no score by more than
    ``tolerance`` (of the score, where that is over 1).  A round passes on the
    damped part of what the one before changed, so that this ends.  ``rounds``
    sets their number instead.
    """
    edges = materialise(edges, "edges")
    if edges.isEmpty():
        return seeds
    start = seeds.select("host", F.explode(F.create_map(F.lit("t"), F.col("trust"), F.lit("d"), F.col("distrust"))).alias("kind", "seed"))
    outgoing = edges.groupBy(F.col("src").alias("of")).agg(F.sum("n").alias("total"))
    incoming = edges.groupBy(F.col("dst").alias("of")).agg(F.sum("n").alias("total"))
    ahead = edges.join(outgoing, F.col("src") == F.col("of")).select(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("total")).alias("w"))
    back = edges.join(incoming, F.col("dst") == F.col("of")).select(F.lit("d").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("total")).alias("w"))
    flow = materialise(ahead.unionByName(back), "flow")
    ends = flow.select("kind", F.col("a").alias("host")).union(flow.select("kind", "b")).distinct()
    start = materialise(ends.join(start, ["kind", "host"], "full").select("kind", "host", F.coalesce("seed", F.lit(0.0)).alias("seed")), "seeds")
    score = start.select("kind", "host", F.col("seed").alias("x"))
    along = flow.select("kind", F.col("a").alias("host"), "b", "w")
    def passed_on(x: DataFrame) -> DataFrame:
        given = x.join(along, ["kind", "host"]).groupBy("kind", "b").agg(F.sum(F.col("x") * F.col("w")).alias("got")).withColumnRenamed("b", "host")
        return start.join(given, ["kind", "host"], "left").select("kind", "host", (F.col("seed") + damping * F.coalesce("got", F.lit(0.0))).alias("x"))

    done, change = 0, float("inf")
    while done < rounds if rounds is not None else change > tolerance:
        old, n = score, every if rounds is None else min(every, rounds - done)
        for _ in range(n):
            score = passed_on(score)
        score, done = materialise(score, "scores"), done + n
        if rounds is None:
            was = old.withColumnRenamed("x", "was")
            change = score.join(was, ["kind", "host"]).agg(F.max(F.abs(F.col("x") - F.col("was")) / F.greatest("x", F.lit(1.0)))).first()[0] or 0.0
    pick = lambda kind: F.round(F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("x"))), F.lit(0.0)), 9)
    return score.groupBy("host").agg(pick("t").alias("trust"), pick("d").alias("distrust"))


def judge_urls(pages: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5, damping: float = 0.85, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("r.verdict") == v, 1.0).otherwise(0.0))
    seeds = base.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    hosts = propagate(host_edges(pages, html_col, url_col), seeds, damping=damping)
    bad = hosts.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(True).alias("bad"))
    bad = materialise(bad, "blocked")  # a plain table, so that the join can split a hot host's pages
    out = base.join(bad, "host", "left")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
