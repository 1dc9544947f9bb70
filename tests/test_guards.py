"""Essays and sentences that each guard drops, and clean ones that stay."""

from quillon.operators import guards as gd

SURNAMES = [("Okafor", "a"), ("Lindqvist", "b"), ("Marsh", "c")]
ESSAY = "post int, film string, title string, text string, year int, about boolean, about_many boolean, titles array<string>, hands array<string>"
SENTENCE = "post int, film string, pos int, text string, must_name boolean, titles array<string>, hands array<string>, other_titles array<string>"


def test_essays(spark):
    own = ["quiet harbour"], ["Okafor"]
    rows = [
        (1, "On Quiet Harbour", "Okafor films the docks of Quiet Harbour (1971) at dusk.", True, False, *own),
        (2, "On Quiet Harbour", "Nobody who made it is named here.", True, False, *own),
        (3, "Delgado's Quiet Harbour", "Okafor is named.", True, False, *own),
        (4, "Docks", "Okafor came first, yet Quiet Harbour (1994) is in colour.", True, False, *own),
        (5, "Docks", "Okafor came first; Lindqvist's remake of Quiet Harbour is in colour.", True, False, *own),
        (6, "Docks", "Okafor made Quiet Harbour.", False, False, *own),
        (7, "Docks", "Okafor: quiet harbour, quiet harbour quiet harbour.", False, False, *own),
        (8, "Docks", "Okafor. Marsh and Marsh and Marsh again.", True, False, *own),
        (9, "Docks", "Okafor. A quiet harbour (1994) in passing.", True, True, *own),
        (10, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(p, "a", t, x, 1971, *rest) for p, t, x, *rest in rows], ESSAY)
    got = {r.post: (r.reason, r.must_name) for r in gd.judge_essays(df, spark.createDataFrame(SURNAMES, "name string, film string")).collect()}
    assert got == {1: (None, False), 2: ("no hand", False), 3: ("credited to another", False), 4: ("other version", False), 5: ("other version", False), 6: ("few mentions", True), 7: (None, True), 8: (None, True), 9: (None, True), 10: ("few mentions", True)}


SAID = [
    ("A slow tide of light settles over the empty quays at the end.", None),
    ("Too short.", "length"),
    ("a line of verse without any mark behind it at all, like this", "no sentence"),
    ("Is the harbour a place, a memory, or only a trick of the light?", "question"),
    ("The “harbour of the mind, it has been called, stays empty to the end.", "citation"),
    ("I remember the long shots of the empty quays and their grey light.", "first person"),
    ("According to the programme, the quays were empty for all of a week.", "citation"),
    ("The dialectic of sea and stone runs through its slow grey opening.", "theory"),
    ("Unlike the play, it never leaves the quays and their grey light.", "comparative"),
    ("These figures wait by the water until the light has gone from it.", "pointer"),
    ("Is this one dropped early, and is the carry untouched by it all?", "question"),
    ("They wait by the water, grey and cold, until the last boat leaves.", "pointer"),
    ("The last boat leaves in silence under a low and yellow evening sky.", None),
    ("They wait by the water, grey and cold, until the last boat leaves.", None),
    ("Dockers are often shown asleep among the crates of the lower quay.", "generic"),
    ("Delgado's camera glides over the crates and the sleeping dockers.", "possessive"),
    ("Okafor's films share the grey and patient light of these low quays.", "possessive"),
    ("Okafor's camera glides over the crates and the sleeping dockers.", None),
    ("The light of ⟦Winter Road⟧ returns here over crates and dockers too.", "italic"),
    ("The light of ⟦Quiet Harbour⟧ stays over crates and dockers too.", None),
    ("The light of paper moon returns here over the crates and dockers.", "other film"),
    ("The patient crane shots that Lindqvist favoured return over the quay.", "other hand"),
    ("The grey light of his work returns over the crates and the dockers.", "oeuvre"),
    (None, "length"),
]


def test_sentences(spark):
    rows = [(1, "a", k, t, False, ["quiet harbour"], ["Okafor"], ["paper moon", "quiet harbour"]) for k, (t, _) in enumerate(SAID)]
    rows += [(2, "a", k, t, True, ["quiet harbour"], None, None) for k, t in enumerate(["A slow tide of light settles over the empty quays.", "Quiet Harbour opens on a slow tide of grey light."])]
    surnames = spark.createDataFrame(SURNAMES, "name string, film string")
    out = gd.guard_sentences(spark.createDataFrame(rows, SENTENCE).repartition(3), surnames)
    got = {(r.post, r.pos): r.reason for r in out.collect()}
    assert got == {**{(1, k): why for k, (_, why) in enumerate(SAID)}, (2, 0): "not named", (2, 1): None}
    assert {r.guard: r.n for r in gd.drop_counts(out).collect()}["pointer"] == 2
    assert gd.guard_sentences(spark.createDataFrame([], SENTENCE), surnames).collect() == []
