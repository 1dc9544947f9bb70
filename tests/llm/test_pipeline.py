"""The stages on the small fixture, each against what it must keep."""

import corpus_pipeline as cp
from quillon.llm.common import materialise
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_ngram_join import brute as grouped


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing"]
    seen = [docs]
    for name, stage in cp.STAGES:
        seen.append(materialise(stage(spark, seen[-1], sf), name))
        if name != "mixing":
            assert seen[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in x.collect()] for x in seen]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {d for d, _ in rows[1]}
    good = [d for d, _ in rows[0] if labels.get(d) == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert len(kept) < len(rows[0])
    assert sorted(d for d, _ in rows[2]) == sorted({c for _, _, c in grouped(rows[1], 5, 80)})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {d for d, _ in rows[3]} == {d for d, _ in rows[2]} - {c[0] for c in contained(rows[2], items)}
    assert sorted(d for d, _ in rows[4]) == sorted(d for d, _ in rows[3])
    assert all(r.rate >= 0 for r in seen[-1].collect())


def test_repeated_and_null_ids(spark, sf):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " x", "en", "s", 1), (None, text, "en", "s", 1), (3, "", "en", "s", 0), (4, None, "en", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r.doc_id for r in cp.near_duplicates(spark, d, sf).collect()), key=str) == [1, 3, 4, None]


def test_stages_on_empty_tables_and_clashing_columns(spark, sf, tmp_path):
    """No rows, then long, empty and null texts with columns named like the stages' own."""
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, component_id string, rate string, score string, quillon_row0 int, y int"
    empty = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    extra = (7, "c", "r", "s", 3, 4)
    odd = [(10**6, "", "en", "s", 0), (10**6 + 1, None, None, None, None), (10**6 + 2, "long word " * 100_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, *extra) for r in real + odd], schema)
    for name, stage in cp.STAGES[1:]:
        before = docs
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        assert {10**6, 10**6 + 1, 10**6 + 2} <= {r.doc_id for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == before.columns and {tuple(r)[5:] for r in docs.collect()} == {extra}


def test_texts_of_one_id(spark, sf):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, a), (1, b), (2, b + " more"), (3, "c")]
    d = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r.doc_id, r.text) for r in cp.near_duplicates(spark, d, sf).collect()) == [(1, a), (1, b), (3, "c")]
