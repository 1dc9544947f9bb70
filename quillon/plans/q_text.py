"""Text and parser queries over documents, pages, conversations and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import guards as gd
from quillon.operators import parse as ps
from quillon.plans.registry import query, table

FOLD = "trim(regexp_replace(translate(translate(lower({c}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '''’‘`´', ''), '[^a-z0-9]+', ' ', 'g'))"


@query("folded_text", "T01", f"SELECT doc_id, md5({FOLD.format(c='text')}) AS h FROM documents")
def folded_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.fold(F.col("text")).cast("binary")).alias("h"))


@query("folded_exact", "T01")
def folded_exact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.fold_udf()(F.col("text")).cast("binary")).alias("h"))


@query("title_keys", "T06 T07", f"SELECT DISTINCT p_name, replace(regexp_replace({FOLD.format(c='p_name')}, '^(the|a|an) ', ''), ' ', '') AS key, replace({FOLD.format(c='p_name')}, ' ', '-') AS slug FROM part")
def title_keys(spark, sf):
    return table(spark, sf, "part").select("p_name", tx.title_key(F.col("p_name")).alias("key"), tx.slug(F.col("p_name")).alias("slug")).distinct()


@query("slug_candidates", "T07", "SELECT p_partkey, array_to_string(list_value(replace(p_name, ' ', '-'), replace(p_name, ' ', '-') || '-' || (1916 + 2 * p_size)), '|') AS keys FROM part")
def slug_candidates(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("|", tx.slug_candidates(F.col("p_name"), 1916 + 2 * F.col("p_size"))).alias("keys"))


N1 = "trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("normalised_levels", "T04", f"SELECT conv_id, turn, md5({N1}) AS n1, md5(array_to_string(list_filter(string_split({N1}, ' '), lambda w: w NOT IN ('the', 'a', 'an') AND w <> ''), ' ')) AS n2 FROM conversations")
def normalised_levels(spark, sf):
    c = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(tx.normalise(c, 1).cast("binary")).alias("n1"), F.md5(tx.normalise(c, 2).cast("binary")).alias("n2"))


@query("stemmed_sets", "T04 T05")
def stemmed_sets(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.normalise(F.col("text"), 3).alias("n3"))


@query("page_text", "T11", """SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\\b[^>]*>.*?</(script|style)\\s*>|<!--.*?-->', ' ', 'gis'), '<(i|em)\\b[^>]*>', '⟦', 'gi'), '</(i|em)\\s*>', '⟧', 'gi'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS h FROM pages""")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.html_text(F.col("html")).cast("binary")).alias("h"))


@query("sentences", "T12", "SELECT conv_id, turn, len(list_filter(regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+$'), lambda s: trim(s, ' ' || chr(10)) <> '')) AS n FROM conversations")
def sentences(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(tx.sentence_list(F.col("text"))).alias("n"))


SPLIT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(s, ' ')), lambda s: s <> '')"


@query("first_sentences", "T13", f"WITH s AS (SELECT doc_id, {SPLIT} AS s FROM documents), k AS (SELECT doc_id, s, list_max(list_filter(range(1, least(len(s), 201) + 1), lambda k: length(array_to_string(s[1:k], ' ')) <= 200)) AS k FROM s) SELECT doc_id, CASE WHEN len(s) = 0 THEN '' WHEN length(s[1]) > 200 THEN substring(s[1], 1, 200) ELSE array_to_string(s[1:k], ' ') END AS lead FROM k")
def first_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.first_sentences(F.col("text"), 200).alias("lead"))


@query("truncated", "T15", "SELECT doc_id, length(CASE WHEN length(text) <= 500 THEN text ELSE substring(text, 1, 500) END) AS n FROM documents")
def truncated(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(tx.truncate_at_paragraph(F.col("text"), 500)).alias("n"))


@query("text_chunks", "T14")
def text_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(tx.chunk_udf(128, 16)(F.col("text"))).alias("chunk_no", "text"))


@query("wikitext", "T08 T09 Z06")
def wikitext(spark, sf):
    rows = [(1, "Lead {{x|{{y}}}} text.<ref>no</ref>\n== Plot ==\nA [[man|person]] '''runs'''.\n== Cast ==\n* One\n{| class=a\n| b\n|}")]
    d = spark.createDataFrame(rows, "id int, w string")
    return d.select("id", tx.strip_wikitext_udf()(F.col("w")).alias("plain"), tx.plot_section(F.col("w")).alias("plot"), F.size(tx.sections(F.col("w"))).alias("n"))


@query("heading_classes", "T10 Z05", "SELECT p_name, CASE WHEN p_name LIKE 'red%' THEN 'warm' WHEN p_name LIKE 'blue%' THEN 'cold' WHEN p_name LIKE '%ring%' THEN 'warm' END AS class FROM part")
def heading_classes(spark, sf):
    return table(spark, sf, "part").select("p_name", tx.heading_class(F.col("p_name"), {"warm": (("red",), ("ring",)), "cold": (("blue",), ())}).alias("class"))


@query("claim_text", "T16", "SELECT o_orderkey, CASE count(*) WHEN 1 THEN min(s) ELSE array_to_string(list(s ORDER BY s)[:-2], ', ') || ' and ' || max(s) END AS claim FROM (SELECT DISTINCT l_orderkey AS o_orderkey, CAST(l_suppkey AS VARCHAR) AS s FROM lineitem) GROUP BY o_orderkey")
def claim_text(spark, sf):
    from quillon.operators.graph import claim

    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("s"))
    return s.select("o_orderkey", claim(F.col("s")).alias("claim"))


W4 = f"list_distinct(list_filter(string_split({FOLD.format(c='text')}, ' '), lambda w: length(w) >= 4))"


@query("turn_overlap", "T17 A45 A54", f"WITH w AS (SELECT conv_id, turn, {W4} AS w FROM conversations) SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) * 1.0 / len(a.w) END, 6) AS overlap FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def turn_overlap(spark, sf):
    w = table(spark, sf, "conversations").select("conv_id", "turn", tx.content_words(F.col("text"), []).alias("w"))
    b = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("next"))
    return w.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.word_overlap(F.col("w"), F.col("next")), 6).alias("overlap"))


@query("cue_flags", "T20", "SELECT doc_id, regexp_matches(text, '[a-z,;] [A-Z][a-z]+') AS proper, regexp_matches(text, '(?i)\\b(no|not|never|without|nor|neither|isn''t|don''t|doesn''t|nothing)\\b') AS negated FROM documents")
def cue_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.has_proper_noun(F.col("text")).alias("proper"), tx.has_negation(F.col("text")).alias("negated"))


@query("encoded_words", "T18 T19")
def encoded_words(spark, sf):
    """Static mean of known words' vectors, and greedy word pieces, with tables that are given."""
    vectors = {"red": [1.0, 0.0], "ring": [0.0, 1.0], "blue": [-1.0, 0.0], "bolt": [0.0, -1.0]}
    vocabulary = {"red", "ri", "##ng", "blue", "bo", "##lt"}

    encode = F.pandas_udf(lambda s: tx.static_encode(s.map(list), vectors, 2), "array<double>")
    pieces = F.pandas_udf(lambda s: s.map(lambda w: tx.wordpieces(list(w), vocabulary)), "array<string>")
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_name").distinct().select("p_name", encode(words).alias("vector"), pieces(words).alias("pieces"))


LEXICON = {
    "phrases": {"colour:warm": ["red", "orange"], "colour:cold": ["blue", {"phrase": "not warm", "polarity": "inherent"}], "size:small": ["small", "tiny", "little"], "size:large": ["large", "big"], "form:ring": ["ring", "ring shaped"], "form:bolt": ["bolt"]},
    "negation": ["no", "not", "without", "never"], "up": ["very", "really"], "down": ["a bit", "slightly", "kind of"], "stop": ["a", "the", "and", "but", "with", "of", "something", "i", "want"],
    "guards": [("best ring", "a judgement, not an attribute", "judgement")], "cues": [("like", None), ("the colour of", "colour")],
    "groups": {"colour": ["colour:warm", "colour:cold"], "size": ["size:small", "size:large"]}, "neighbours": {"colour": ["colour", "size"]},
}
SENTENCES = ["something very small and blue, not a ring", "like red widget but without bolts", "a bit large, zorbnax frobnitz", "the best ring, never warm, not blue", "the colour of red widget, really big", "like no such thing"]


def _parsed(spark):
    lexicon = ps.Lexicon.build(LEXICON["phrases"], LEXICON["negation"], LEXICON["up"], LEXICON["down"], LEXICON["stop"], LEXICON["guards"], LEXICON["cues"], LEXICON["groups"], LEXICON["neighbours"])
    works = ps.Works({"red widget": "1"}, {"1": {"colour:warm": (1.0, 1.2), "size:small": (0.5, 0.9)}})
    return ps.parse_sentences(spark.createDataFrame(list(enumerate(SENTENCES)), "query int, said string"), "said", lexicon, works)


@query("parsed_clauses", "Q01 Q02 Q04 Q05 T02 T03 Z20")
def parsed_clauses(spark, sf):
    return ps.clause_rows(_parsed(spark), "query").withColumn("any_of", F.concat_ws("|", "any_of"))


@query("unread_spans", "Q03")
def unread_spans(spark, sf):
    return _parsed(spark).select("query", F.explode("reading.unread").alias("u")).select("query", "u.text", "u.kind", "u.why")


NAME_LEXICON = {"hue:warm": ["red"], "hue:cold": ["blue", "green"], "size:small": ["small"], "size:large": ["large"], "form:round": ["ring"], "form:long": ["bolt", "rod"]}
NAMED_SQL = """WITH lex(word, attr) AS (VALUES ('red', 'hue:warm'), ('blue', 'hue:cold'), ('green', 'hue:cold'), ('small', 'size:small'), ('large', 'size:large'), ('ring', 'form:round'), ('bolt', 'form:long'), ('rod', 'form:long')),
p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), a AS (SELECT p_partkey, w[1] AS first, w[-1] AS last, x.attr AS one, y.attr AS two FROM p LEFT JOIN lex x ON x.word = w[1] LEFT JOIN lex y ON y.word = w[-1])"""


def _said(spark, sf):
    """A sentence of each part's name, read: very <first word>, not a <last word> form."""
    lexicon = ps.Lexicon.build(NAME_LEXICON, ["not"], ["very"], [], ["a"], namespaces=["form"])
    words = F.split("p_name", " ")
    said = F.concat(F.lit("very "), F.element_at(words, 1), F.lit("; not a "), F.element_at(words, -1), F.lit(" form"))
    return ps.parse_sentences(table(spark, sf, "part").select("p_partkey", said.alias("said")), "said", lexicon)


@query("name_clauses", "Q01 Q02 Q04 T02 T03 Z20", f"{NAMED_SQL} SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY place) - 1 AS INT) AS clause, attr AS any_of, weight, negate FROM (SELECT p_partkey, 0 AS place, one AS attr, 1.5 AS weight, false AS negate FROM a WHERE one IS NOT NULL UNION ALL SELECT p_partkey, 1, two, 1.0, true FROM a WHERE two IS NOT NULL)")
def name_clauses(spark, sf):
    return ps.clause_rows(_said(spark, sf), "p_partkey").withColumn("any_of", F.concat_ws("|", "any_of"))


@query("name_readings", "Q02 Q03", f"{NAMED_SQL} SELECT p_partkey, CASE WHEN one IS NOT NULL THEN 'very ' || first END AS early, CASE WHEN two LIKE 'form:%' THEN 'not a ' || last || ' form' WHEN two IS NOT NULL THEN 'not a ' || last END AS late, CAST(CASE WHEN one IS NULL THEN 1 ELSE 0 END + CASE WHEN two IS NULL THEN 1 WHEN two LIKE 'form:%' THEN 0 ELSE 1 END AS INT) AS unread FROM a")
def name_readings(spark, sf):
    """What each reading took of its sentence, with a family's name behind it, and how many spans nothing read."""
    x = F.col("reading.readings")
    text = lambda negate: F.get(F.filter(x, lambda r: r["negate"] == negate), F.lit(0))["text"]
    return _said(spark, sf).select("p_partkey", text(False).alias("early"), text(True).alias("late"), F.size("reading.unread").alias("unread"))


@query("clause_conflicts", "Q04")
def clause_conflicts(spark, sf):
    return _parsed(spark).select("query", F.size("reading.conflicts").alias("n"))


@query("record_marks", "Q08 J12", "SELECT 'economy' AS text, 'genre' AS facet, 'ECONOMY' AS value")
def record_marks(spark, sf):
    spans = spark.createDataFrame([("economy",), ("nothing",)], "text string")
    p = table(spark, sf, "part")
    marks = p.select(F.col("p_type").alias("name"), F.lit("genre").alias("facet"), F.col("p_type").alias("value")).unionByName(p.select(F.col("p_brand").alias("name"), F.lit("brand").alias("facet"), F.col("p_brand").alias("value")))
    return ps.record_marks(spans, marks)


@query("interpreted_reply", "F28 F05 Z24")
def interpreted_reply(spark, sf):
    rows = [(1, '{"clauses":[{"attr":"size:small","weight":9},{"attr":"made:up","weight":1},{"attr":"size:small","weight":1},{"attr":"colour:cold","negate":true}],"unread":["x"]}'), (2, "no json"), (3, None)]
    d = spark.createDataFrame(rows, "id int, reply string").withColumn("x", ps.accept_interpretation(F.col("reply"), ["size:small", "colour:cold"]))
    return d.select("id", F.size("x.clauses").alias("n"), F.get("x.clauses", F.lit(0))["weight"].alias("first_weight"), F.size("x.unread").alias("unread"))


@query("lexicon_matches", "T21 J22", "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, i AS start, CASE WHEN w[i] || ' ' || coalesce(w[i + 1], '') IN ('red ring', 'blue bolt') THEN w[i] || ' ' || w[i + 1] ELSE w[i] END AS phrase FROM w, range(1, 3) t(i) WHERE w[i] IN ('red', 'ring') OR w[i] || ' ' || coalesce(w[i + 1], '') IN ('red ring', 'blue bolt')")
def lexicon_matches(spark, sf):
    phrases = spark.createDataFrame([("red",), ("ring",), ("red ring",), ("blue bolt",)], "phrase string")
    return ps.lexicon_matches(table(spark, sf, "part"), "p_partkey", "p_name", phrases, 2)


MOST_BEGINS = 10_000  # first words that are looked up; with more of them all runs are joined


@query("mentions", "J22 X04 S13", """WITH b AS (SELECT item_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[1:8] AS w FROM benchmark) SELECT doc_id, count(DISTINCT item_id) AS items FROM documents JOIN b ON contains(' ' || regexp_replace(documents.text, '\\s+', ' ', 'g') || ' ', ' ' || array_to_string(w, ' ') || ' ') GROUP BY doc_id""")
def mentions(spark, sf):
    """Documents that hold the first eight words of an item: an n-gram equi-join, no pairing of all texts."""
    first = table(spark, sf, "benchmark").select("item_id", F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), 1, 8).alias("w"))
    begins = [r[0] for r in first.select(F.element_at("w", 1)).distinct().limit(MOST_BEGINS + 1).collect()]
    words = table(spark, sf, "documents").select("doc_id", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w"))
    at = F.sequence(F.lit(1), F.size("w") - 7)
    if len(begins) <= MOST_BEGINS:  # runs are built only where an item may begin
        at = F.filter(at, lambda i: F.element_at("w", i).isin(begins))
    grams = words.where(F.size("w") >= 8).select("doc_id", F.explode(F.transform(at, lambda i: F.concat_ws(" ", F.slice(F.col("w"), i, F.lit(8))))).alias("gram"))
    return grams.join(first.select("item_id", F.concat_ws(" ", "w").alias("gram")), "gram").groupBy("doc_id").agg(F.count_distinct("item_id").alias("items"))


# What a critic may write of a part, and why it is dropped: (sentence, reason, opens with a pointer).
REVIEWS = [
    ("The {} lies grey and still beneath a slow and yellow light.", None, False),
    ("Is the {} a place, a memory, or only a trick of the light?", "question", False),
    ("Unlike the others, the {} never leaves the grey and slow light.", "comparative", False),
    ("These lie beside the {} until the slow light has gone from it.", None, True),
    ("According to some, the {} was left empty for all of a week.", "citation", False),
    ("They wait near the {} in the cold until the last light has gone.", None, True),
    ("The {} follows the dialectic of sea and stone in slow light.", "theory", False),
    ("Delgado's camera glides over the {} and its slow grey light.", "possessive", False),
    ("The ⟦Winter Road⟧ stands here behind the {} in slow grey light.", "italic", False),
    ("The patient shots that Lindqvist favoured show the {} in light.", "other hand", False),
    ("Short {}.", "length", False),
    ("The grey light of his work returns over the {} and its crates.", "oeuvre", False),
]
ESSAYS = [("{}", "Okafor films {} ({y}) at dusk.", True), ("{}", "Nobody who made {} is named.", True), ("Delgado's {}", "Okafor made it.", True), ("{}", "Okafor came before {} (2099).", True), ("{}", "Okafor came first; Lindqvist's remake of {} is later.", True), ("{}", "Okafor made {}.", False), ("{}", "{}, {}, {}: all Okafor.", False), ("{}", "Okafor. Marsh, Marsh, Marsh on {}.", True)]
SURNAMES = [("Okafor", 1), ("Lindqvist", 2), ("Marsh", 3)]
_VALUES = ", ".join("({}, {}, {}, {})".format(k, f"'{why}'" if why else "CAST(NULL AS VARCHAR)", why in gd.OFF_FILM, why in ("length", "question")) for k, (_, why, _) in enumerate(REVIEWS))
REVIEWED_SQL = f"""WITH t(k, why, off, early) AS (VALUES {_VALUES}), s AS (SELECT p_partkey, p_partkey // 10 AS post, why, off, early, k IN (3, 5) AS points FROM part JOIN t ON k = p_size % {len(REVIEWS)}),
c AS (SELECT *, last_value(CASE WHEN NOT early AND NOT points THEN off END IGNORE NULLS) OVER (PARTITION BY post ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM s)
SELECT p_partkey, CASE WHEN points AND carried THEN 'pointer' ELSE why END AS reason FROM c"""


def _chosen(items, by, name):
    """The template that ``by`` picks, with the part's name in it."""
    return F.replace(F.element_at(F.array(*map(F.lit, items)), (by % len(items) + 1).cast("int")), F.lit("{}"), name)


def _reviews(spark, sf):
    """One sentence of each part; ten parts in a row are a post."""
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 10).alias("post"), F.lit(1).alias("film"), F.col("p_partkey").alias("pos"), _chosen([t for t, _, _ in REVIEWS], F.col("p_size"), F.col("p_name")).alias("text"))
    rows = p.select("*", F.lit(False).alias("must_name"), F.array(F.lit("quiet harbour")).alias("titles"), F.array(F.lit("Okafor")).alias("hands"), F.array(F.lit("paper moon")).alias("other_titles"))
    return gd.guard_sentences(rows, spark.createDataFrame(SURNAMES, "name string, film int"))


@query("prose_guards", "F23", REVIEWED_SQL)
def prose_guards(spark, sf):
    """Why the sentence of each part is dropped; sentences with pointers follow the one before."""
    return _reviews(spark, sf).select(F.col("pos").alias("p_partkey"), "reason")


@query("guard_drops", "F23", f"SELECT coalesce(reason, 'kept') AS guard, count(*) AS n FROM ({REVIEWED_SQL}) GROUP BY 1")
def guard_drops(spark, sf):
    return gd.drop_counts(_reviews(spark, sf))


@query("essay_guards", "F23", "SELECT p_partkey, CASE p_size % 8 WHEN 1 THEN 'no hand' WHEN 2 THEN 'credited to another' WHEN 3 THEN 'other version' WHEN 4 THEN 'other version' WHEN 5 THEN 'few mentions' END AS reason, p_size % 8 IN (5, 6, 7) AS must_name FROM part")
def essay_guards(spark, sf):
    """An essay of each part, with its name as title: refused, or held to sentences that name it."""
    title, by, year = F.initcap("p_name"), F.col("p_size"), 1916 + 2 * F.col("p_size")
    about = F.element_at(F.array(*(F.lit(a) for _, _, a in ESSAYS)), (by % len(ESSAYS) + 1).cast("int"))
    text = F.replace(_chosen([x for _, x, _ in ESSAYS], by, title), F.lit("{y}"), year.cast("string"))
    essays = table(spark, sf, "part").select(F.col("p_partkey").alias("post"), F.lit(1).alias("film"), _chosen([t for t, _, _ in ESSAYS], by, title).alias("title"), text.alias("text"), year.alias("year"), about.alias("about"), F.lit(False).alias("about_many"), F.array(tx.fold(F.col("p_name"))).alias("titles"), F.array(F.lit("Okafor")).alias("hands"))
    return gd.judge_essays(essays, spark.createDataFrame(SURNAMES, "name string, film int")).select(F.col("post").alias("p_partkey"), "reason", "must_name")


@query("keyword_folding", "F01 S04", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(lower(trim(p_name)), ' '), lambda w: length(w) > 2 AND w NOT IN ('red', 'large')), lambda w: 'kw:' || w))), ',') AS kw FROM part")
def keyword_folding(spark, sf):
    words = F.filter(F.split(F.lower(F.trim("p_name")), " "), lambda w: (F.length(w) > 2) & ~w.isin("red", "large"))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(words, lambda w: F.concat(F.lit("kw:"), w))))).alias("kw"))
