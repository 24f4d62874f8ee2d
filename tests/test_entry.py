"""The entry file: every query has a name and a schema, and some agree with their oracle on the smallest tables."""

import pytest
from oracle_compare import compare, connect

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["e6_top_roots", "p3_found", "p2_found", "b9_pos_backfill", "b11_relabel", "h8_suffixation", "h10_compound", "k1_roc_auc", "e7_spot_check_neighbours", "i9_random_walks", "j4_sage_mean"])
def test_oracles(spark, name):
    q, o = entry.queries(), entry.oracle_sql()
    got, want = compare(spark, connect(DIR), DIR, q[name], o[name])
    assert got == want


def test_reverse_lookup_finds_long_variants(spark):
    q, o = entry.queries(), entry.oracle_sql()
    rows = {r["variant"]: r["noun"] for r in q["c9_reverse_lookup"](spark, DIR).collect()}
    nouns = {r["word"] for r in q["b3_known_words"](spark, DIR).filter("pos = 'noun'").collect()}
    long = {w for w in nouns if len(w) > 4}
    assert long and long <= set(rows) and set(rows.values()) <= nouns
    got, want = compare(spark, connect(DIR), DIR, q["c9_reverse_lookup_short"], o["c9_reverse_lookup_short"])
    assert got == want


def test_components_and_walks_cover_all_words(spark):
    q = entry.queries()
    words = {r["word"] for r in q["d2_degrees"](spark, DIR).collect()}
    for name in ("i2_weak_components", "i3_strong_components"):
        assert {r["word"] for r in q[name](spark, DIR).collect()} == words
    walks = q["i9_random_walks_whole"](spark, DIR).collect()
    assert {r["word"] for r in walks} == words and len(walks) == 10 * len(words)
