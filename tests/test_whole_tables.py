"""Queries that once read a part of their tables: against brute force over all of it."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq

from quillon.functions import stats
from quillon.operators import audit as au
from quillon.operators import graph as g
from quillon.plans import q_audit, q_graph, q_stats


def _rows(sf, name, *columns):
    return list(zip(*(pq.read_table(f"{sf}/{name}.parquet", columns=[c])[c].to_pylist() for c in columns), strict=True))


def _pairs(members):
    """All pairs of entities that share a key."""
    by = defaultdict(set)
    for key, entity in members:
        by[key].add(entity)
    return {p for group in by.values() for p in combinations(sorted(group), 2)}


def test_proposals_of_all_pairs(spark, sf):
    person = dict(_rows(sf, "orders", "o_orderkey", "o_custkey"))
    crew = _pairs(((role, person[o]), part) for part, role, o in _rows(sf, "lineitem", "l_partkey", "l_returnflag", "l_orderkey") if o in person)
    shared = q_graph._attrs(spark, sf).where("field = 'country' AND idf >= 0.14 OR field = 'keyword'").select("field", "value", "entity", "idf").collect()
    country = _pairs((r["value"], r["entity"]) for r in shared if r["field"] == "country")
    got = defaultdict(set)
    for r in q_graph._proposals(spark, sf).select("a", "b", "signal").collect():
        got[r["signal"]].add((r["a"], r["b"]))
    assert got["crew"] == crew and got["genre"] == country
    assert got["setting"] <= _pairs((r["value"], r["entity"]) for r in shared if r["field"] == "keyword")
    assert {(a + b) % 7 for a, b in got["setting"]} == set(range(7))


def test_selection_and_alternates_of_all_pairs(spark, sf):
    chosen = {r["pair"]: (int(r["a"]), int(r["b"])) for r in q_graph.selected_edges(spark, sf).collect()}
    assert {(a + b) % 7 for a, b in chosen.values()} == set(range(7))
    also = [r["pair"] for r in q_graph.also_signals(spark, sf).collect()]
    assert set(also) <= set(chosen) and {sum(chosen[p]) % 7 for p in also} == set(range(7))


SF = "/root/testdata/sf0.01"  # has parts and customers from 300 on


def test_core_of_all_edges(spark):
    edges = [(r["a"], r["b"]) for r in q_graph._crew_edges(spark, SF).collect()]
    want = g.connected_core(sorted({x for e in edges for x in e}), edges, [1, 2], 40)
    got = [r["entity"] for r in q_graph.connected_core(spark, SF).collect()]
    assert sorted(got) == sorted(want) and max(got) >= 300


def test_intervals_of_all_customers(spark):
    by = defaultdict(list)
    for segment, x, y in _rows(SF, "customer", "c_mktsegment", "c_acctbal", "c_custkey"):
        by[segment].append((float(x), float(y)))
    want = {}
    for segment, rows in by.items():
        x, y = (np.array(c) for c in zip(*sorted(rows), strict=True))
        want[segment] = stats.bootstrap_interval(x, y, 100, 42)
    assert {r["key"]: (r["lo"], r["hi"]) for r in q_stats.bootstrap_interval(spark, SF).collect()} == want


def test_family_scores_by_the_number_of_parts(spark, sf):
    parts = len(_rows(sf, "part", "p_partkey"))
    tags = q_audit._with_outcomes(q_audit._sparse(spark, sf))
    rows = lambda df: sorted(map(tuple, df.where("k > 1").collect()))
    want = rows(au.score_predicate_pairs(tags, parts, [("won", "lost")]))
    assert parts != 2000 and want and rows(q_audit.family_scores(spark, sf)) == want
    assert want != rows(au.score_predicate_pairs(tags, 2000, [("won", "lost")]))
