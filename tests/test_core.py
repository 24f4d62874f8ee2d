"""Core operators on small tables: brute force, nulls, repeats, blanks, empty tables, clashing columns."""

import json
import math
import random

import numpy as np
import pytest
from derivagraph.functions import rules, text
from derivagraph.functions.spelling import plain_spelling, to_plain
from derivagraph.operators import crawl, curate, derive, embed, fullbatch, graph, layers, metrics, models, orphans, sampling, search, tape, training
from derivagraph.operators.components import connected_components
from derivagraph.operators.hierarchy import build_hierarchy, descendants, ring_members, subtree
from derivagraph.plans import reference_queries
from derivagraph.scratch import Scratch
from derivagraph.sources import pages, runs
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F


def test_plain_spelling_examples():
    assert to_plain("нyбёкeй") == "нубёкей"
    assert to_plain("ｆüｌａ") == "füla"
    assert to_plain("մﬔ­ա‐բ ") == "ммեա-բ".replace("мм", "մմ")
    assert to_plain("գեւղ") == "գևղ"
    assert to_plain(" a  b ") == "a b"


@given(st.text(max_size=30))
def test_plain_spelling_is_settled(s):
    p = to_plain(s)
    assert p == p.strip(" ") and "​" not in p


def brute_tree(links):
    par = {}
    for p, c in links:
        if p is not None and c is not None:
            par[c] = min(par.get(c, p), p)
    out = {}
    for w in set(par) | set(par.values()):
        path, x = [w], w
        while x in par and len(path) <= len(par) + 1:
            x = par[x]
            path.append(x)
        out[w] = ("", -1) if len(path) > len(par) + 1 else (x, len(path) - 1)
    return par, out


def test_hierarchy(spark):
    rng = random.Random(0)
    links = [(f"n{i - rng.randint(1, min(i, 3))}", f"n{i}") for i in range(1, 120)]  # long chains
    links += [("hub", f"h{i}") for i in range(200)] + [("x", "x"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r1", "below"), ("below", "deeper"), (None, "q"), ("q", None), ("hub", "h1"), ("a1", "h1")]
    df = spark.createDataFrame([(p, c, "z") for p, c in links], "parent string, child string, word string")
    h = Scratch(spark).cut(build_hierarchy(df, with_path=True))
    par, want = brute_tree(links)
    got = {r["word"]: r for r in h.collect()}
    assert {w: (r["root"], r["node_depth"]) for w, r in got.items()} == want
    kids = {}
    for c, p in par.items():
        kids.setdefault(p, []).append(c)

    def below(w):
        return {w}.union(*(below(k) for k in kids.get(w, [])))

    for w, r in got.items():
        if r["on_ring"]:
            continue
        b = below(w)
        assert r["size"] == len(b) and r["path"][-1] == w and len(r["path"]) == r["node_depth"] + 1
        assert {x for x, q in got.items() if q["pre"] is not None and r["pre"] <= q["pre"] <= r["post"]} == b
    d = {(x["ancestor"], x["descendant"]) for x in descendants(h).collect() if x["distance"] == got[x["descendant"]]["node_depth"] - got[x["ancestor"]]["node_depth"]}
    assert sorted(r["pre"] for r in got.values() if not r["on_ring"]) == list(range(sum(not r["on_ring"] for r in got.values())))
    assert {w: r["parent"] for w, r in got.items() if r["parent"]} == par and descendants(h).count() == len(d)
    assert d == {(w, x) for w, r in got.items() if not r["on_ring"] for x in below(w) - {w}}
    assert {r["word"] for r in subtree(h, "hub").collect()} == below("hub") - {"hub"}
    rings = {tuple(r) for r in ring_members(df, h).collect()}
    assert rings == {("x", "x"), ("r1", "r1"), ("r1", "r2"), ("r1", "r3")}


def test_hierarchy_of_nothing(spark):
    h = build_hierarchy(spark.createDataFrame([], "parent string, child string"), with_path=True)
    assert h.count() == 0


def test_orphans(spark):
    ts = "2025-01-0{}T00:00:00"
    refs = spark.createDataFrame([(1, "a", ts.format(5)), (2, "b", ts.format(5)), (3, "c", ts.format(1)), (4, "c", None), (5, "zz", None), (6, None, None), (7, "", None), (8, "c", ts.format(9)), (9, "n", ts.format(1)), (9, "n", ts.format(1))], "id long, word string, seen string").select(F.col("id").alias("ref"), "word", F.col("seen").cast("timestamp_ntz").alias("seen_at"), F.lit("x").alias("reason"))
    parents = spark.createDataFrame([("a", ts.format(1)), ("b", ts.format(1)), ("c", ts.format(3)), ("c", ts.format(4)), ("n", ts.format(3)), ("n", None), ("k", None), (None, None)], "word string, t string").select("word", F.col("t").cast("timestamp_ntz").alias("exists_from"))
    dead = spark.createDataFrame([("b",)], "word string")
    got = sorted((r["ref"], r["reason"]) for r in orphans.find_orphans(refs, parents, dead).collect())
    assert got == [(2, "deleted"), (3, "early"), (5, "missing")]
    assert orphans.find_orphans(refs.limit(0), parents, dead).count() == 0
    assert orphans.find_orphans(refs, parents.limit(0)).count() == 8


def test_runs_and_borders(spark):
    ids = spark.createDataFrame([(b, i) for b in (0, 1) for i in [1, 2, 3, 7, 8]] + [(1, 9)], "block long, id long")
    asked = spark.createDataFrame([(0, i, "x") for i in [0, 3, 4, 8, 9]] + [(1, 9, "x"), (1, 10, "y"), (2, 1, "z")], "block long, id long, word string")
    assert sorted((r["block"], r["id"]) for r in orphans.runs_of(ids).selectExpr("block", "`end` AS id").collect()) == [(0, 3), (0, 8), (1, 3), (1, 9)]
    assert sorted(tuple(r) for r in orphans.beyond_runs(asked, orphans.runs_of(ids)).collect()) == [(0, 0, "x"), (0, 4, "x"), (0, 9, "x"), (1, 10, "y"), (2, 1, "z")]


def test_plain_spelling_of_words_with_a_line_break(spark):
    rows = [("գիր\n",), ("գիր\r\n",), ("գիր\u0085",), ("գիր\u2028",), ("գիր",), (None,), ("",), ("եւ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "w string").select(plain_spelling("w")).collect()]
    assert got == ["գիր"] * 5 + [None, "", "և"]


def test_instants(spark):
    rows = [("2025-01-02T03:04:05Z",), ("2025-01-02T07:04:05.000000+04:00",), ("2025-01-02T03:04:05",), ("2025-01-02 03:04:05+00:00",), ("nonsense",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(orphans.parse_instant("s")).collect()]
    assert len({str(x) for x in got[:4]}) == 1 and got[4] is None and got[5] is None


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(300)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(150)] + [(7000, 7000), (None, 3), (1, 2)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, local=0).collect()}
    assert connected_components(df).count() == len(got) and got == {r["node"]: r["component"] for r in connected_components(df).collect()}
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(par)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


WORDS = [("գիր", "noun"), ("գրել", "verb"), ("գրություն", "noun"), ("սեր", "noun"), ("սիրել", "verb"), ("սիրվել", "verb"), ("մի", "numeral"), ("մի-մի", "adverb"), ("տուն", "noun"), ("ծաղիկ", "noun"), ("ծաղկիկ", "noun"), ("Մոսկվա", "noun"), ("լույս", "noun"), ("լուսային", "adjective"), ("լավ", "adjective"), ("լավություն", "noun"), ("ապալավ", "adjective"), ("մեծատուն", "noun"), ("ինտերնետ", "noun"), ("սիրում", "noun"), ("կարդալ", "verb"), ("կարդացնել", "verb")]


def test_rules(spark):
    lex = derive.Lexicon(spark.createDataFrame(WORDS, "word string, pos string"))
    e = {(r["source"], r["relation"], r["target"]) for r in derive.analyze(lex.words, lex).collect()}
    assert ("մի", "reduplication", "մի-մի") in e
    assert ("սիրել", "detransitive", "սիրվել") in e
    assert ("կարդալ", "causative", "կարդացնել") in e
    assert ("սիրել", "nominalization", "սիրում") in e
    assert ("ծաղիկ", "diminutive", "ծաղկիկ") in e
    assert ("սեր", "derives_noun", "սիրել") in e  # a noun one form of which is the stem
    assert ("լավ", "deadjectival_suffixation", "լավություն") in e
    assert ("լույս", "denominal_suffixation", "լուսային") in e
    assert ("լավ", "temporal_prefix", "ապալավ") in e
    assert ("մեծ", "root_compound", "մեծատուն") in e and ("տուն", "root_compound", "մեծատուն") in e
    assert not any(t == "ինտերնետ" for _, _, t in e)
    inv = {(r["source"], r["relation"], r["target"]) for r in derive.inverse_edges(derive.analyze(lex.words, lex)).collect()}
    assert ("սիրվել", "causative_base", "սիրել") in inv and not any("compound" in r for _, r, _ in inv)
    none = derive.Lexicon(spark.createDataFrame([], "word string, pos string"))
    assert derive.analyze(none.words, none).count() == 0


PAGE = """==Գոյական==
# [[գիր|Գրի]] '''նշան''' {{x|y}} մեկ
# երկրորդ
=== Բաղադրյալ բառեր ===
* [[գրագետ]] [[գրիչ|գ]] [[two words]] [[Կատեգորիա:x]] [[latin]] {{բաղ|գրադարան|n=1}}
== Ստուգաբանություն ==
[[գիր]] + [[-ություն]] և [[մեծ]]- + [[տուն]] կամ [[քար]] + -[[սիրտ]], [[ոչ]]- + -[[այս]]
{{der-top}}
* [[գրող]]
{{der-bottom}}"""


def test_page_functions(spark):
    d = spark.createDataFrame([("գիր", PAGE), ("գիր", ""), ("x", None), ("գիր", "{{-hy-բայ-}} ==Գոյական==")], "title string, page string")
    r = d.select(text.page_pos("page").alias("p"), text.first_definition("page").alias("d"), text.compound_links("page", "title").alias("c"), text.etymology_parts("page", "title").alias("e")).collect()
    assert r[0]["p"] == "noun" and r[0]["d"] == "Գրի նշան  մեկ".replace("Գրի", "գիր") and r[0]["c"] == ["գրագետ", "գրիչ", "գրադարան", "գրող"]
    assert r[0]["e"] == ["-ություն", "մեծ", "սիրտ", "տուն", "քար"]  # the page's own title and the pair with two hyphens are out
    assert r[1]["p"] == "unknown" and r[1]["d"] == "" and r[2]["d"] == "" and r[3]["p"] == "verb"


def test_rule_tables():
    """Counts written down by hand, and nothing but letters of the alphabet in any table of word parts."""
    assert len(rules.SUFFIX_TABLE) == 56 and len(rules.PREFIX_TABLE) == 11 and len(rules.lines(rules.ROOT_FORMS)) == 45
    assert len(rules.ROOTS) == 53 and len(rules.BORROWINGS.split()) == 21 and len(rules.VERB_ROOTS.split()) == 23 and len(rules.SEEDS) == 51
    assert len(rules.INVERSE_TABLE) == 14 and len(rules.POS_ORDER) == 4
    words = [*rules.SUFFIXES, *rules.PREFIXES, *rules.ROOTS, *rules.BORROWINGS.split(), *rules.VERB_ROOTS.split(), *[w for w, _ in rules.SEEDS], *[w for r in rules.lines(rules.ROOT_FORMS) for w in r]]
    words += [*rules.HUMAN_SUFFIXES.split(), *rules.HUMAN_STEMS.split(), *[r[0] for r in rules.entries(rules.DECLENSIONS)], *[r[0] for r in rules.entries(rules.ACTIONS)], *rules.DEMONYM_ENDINGS.split()]
    assert all("\u0561" <= c <= "\u0587" for w in words for c in w)
    assert [w for w, _ in rules.SEEDS[:10]] == ["աղ", "հաց", "ջուր", "արև", "նվեր", "սեր", "գիր", "գրիչ", "գրություն", "գրագետ"] and rules.SEEDS[-1] == ("մոլ", "noun")
    assert ("ved" not in rules.SUFFIXES) and {r[1:] for r in rules.SUFFIX_TABLE} >= {("\u057e\u0561\u056e", "verb", "noun", "deverbal")}


def test_word_functions(spark):
    w = spark.createDataFrame([("*և-ա1",), ("",), (None,), ("ա",), ("Ա1բ",), ("123",)], "word string")
    got = w.select(text.clean_word("word").alias("c"), text.is_proper_or_invalid("word").alias("b"), text.trigrams("word").alias("t")).collect()
    assert [r["c"] for r in got] == ["և-ա", "", "", "ա", "Ա", ""] and all(r["b"] for r in got[1:])
    assert got[3]["t"] == ["#ա#"] and got[2]["t"] == []
    assert {r[0] for r in rules.canonical_classes()} >= {r[1] for r in rules.RENAME_TABLE} and len(rules.canonical_classes()) == 36


def test_curation(spark):
    nodes = spark.createDataFrame([("a", "noun", *[""] * 6), ("a", "verb", *[None] * 6), ("lonely", "noun", *[""] * 6)], ", ".join(f"{c} string" for c in curate.NODE))
    cols = ", ".join(f"{c} string" for c in derive.EDGE)
    edges = spark.createDataFrame([("a", "", "derives_noun", "", "b", ""), ("a", "", "nominalization", "", "b", ""), ("a", "", "derives_noun", "", "c", ""), ("x", "", "causative", "", "y", ""), ("a", "", "derives_noun", "", "c", "")], cols)
    n, e = curate.curated_graph(nodes, edges)
    assert sorted((r["relation"], r["target"]) for r in e.collect()) == [("derives_noun", "c"), ("nominalization", "b")]
    assert sorted((r["word"], r["pos"]) for r in n.collect()) == [("a", "noun"), ("b", "unknown"), ("c", "unknown")]
    assert {r["relation"]: r["relation_class"] for r in curate.relabel(edges).collect()} == {"nominalization": "suffixation", "causative": "derivation"}
    assert sorted(r["id"] for r in curate.dense_ids(nodes).collect()) == [0, 1]


def test_graph_and_walks(spark):
    e = spark.createDataFrame([(a, "r", b) for a, b in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("a", "b"), ("f", "g"), ("g", "f"), ("g", "h")]], "source string, relation string, target string")
    scc = {r["word"]: r["component"] for r in graph.strong_components(e, Scratch(spark)).collect()}
    assert scc == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "f", "h": "h"}
    roots = spark.createDataFrame([("a",)], "root string")
    b = {r["word"]: r["distance"] for r in graph.bfs(e, roots, Scratch(spark)).collect()}
    assert b == {"a": 0, "b": 1, "c": 2, "d": 3}
    w = graph.random_walks(e, e.select(F.col("source").alias("word")), 2, 5, 1, Scratch(spark)).collect()
    pairs = {(r["source"], r["target"]) for r in e.collect()}
    assert len(w) == 12 and all((x, y) in pairs for r in w for x, y in zip(r["path"], r["path"][1:], strict=False))


def test_walks_in_blocks_leave_no_shuffle_files(spark):
    rng = random.Random(8)
    e = spark.createDataFrame([(f"w{rng.randint(0, 30)}", f"w{rng.randint(0, 60)}") for _ in range(90)], "source string, target string")
    sc, starts = Scratch(spark), e.select(F.col("source").alias("word"))
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    before = files().size()
    whole, parts = (graph.random_walks(e, starts, 6, 11, 3, sc, **more) for more in ({}, {"block": 20}))
    assert files().size() <= before
    paths = {(r["word"], r["walk"]): r["path"] for r in whole.collect()}
    links, leads = {(r["source"], r["target"]) for r in e.collect()}, {r["source"] for r in e.collect()}
    assert {(r["word"], r["walk"]): r["path"] for r in parts.collect()} == paths and len(paths) == 6 * len(leads)
    for (word, _), path in paths.items():
        assert path[0] == word and all(x in links for x in zip(path, path[1:], strict=False)) and (len(path) == 11 or path[-1] not in leads)


def test_sampling_properties(spark):
    rng = random.Random(4)
    e = spark.createDataFrame(list({(f"w{rng.randint(0, 60)}", rng.choice("rst"), f"w{rng.randint(0, 60)}") for _ in range(200)}), "source string, relation string, target string")
    words = spark.createDataFrame([(f"w{i}", ("noun", "verb", "unknown")[i % 3]) for i in range(61)], "word string, pos string")
    have = {tuple(r) for r in e.collect()}
    for s in sampling.STRATEGIES:
        n = [(r["source"], r["relation"], r["target"]) for r in sampling.negatives(e, words, s).collect()]
        assert n and len(n) == len(set(n)) and not set(n) & have and all(a != b for a, _, b in n)
    capped = sampling.negatives(e, words, "typed", mode="global_cap").count()
    assert capped <= len(have)
    s = sampling.stratified_split(e).toPandas()
    assert len(s) == len(have)
    for _, g in s.groupby("relation"):
        assert (g.split == "train").sum() == int(0.8 * len(g))
    g = sampling.global_split(e).toPandas()
    assert (g.split == "test").sum() == max(1, int(0.1 * len(have)))
    h = sampling.hard_negatives(e, words).toPandas()
    pairs = {(a, c) for a, _, c in have}
    assert all((r.source, r.negative) not in pairs for r in h[h.valid].itertuples())


def test_metrics(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 5) / 5, rng.randint(0, 1)) for _ in range(200)] + [(None, 1), (float("nan"), 0)]
    d = spark.createDataFrame(rows, "score double, label int")
    pos = [s for s, y in rows[:200] if y]
    neg = [s for s, y in rows[:200] if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(metrics.roc_auc(d).first()["auc"], auc, abs_tol=1e-6)
    flipped = d.withColumn("score", -F.col("score"))
    assert math.isclose(metrics.roc_auc(flipped).first()["auc"], 1 - auc, abs_tol=1e-5)
    assert metrics.roc_auc(d.filter("label = 1")).first()["auc"] is None
    t = metrics.scores_at(d, 9.0).first()
    assert (t["precision"], t["recall"], t["f1"]) == (0.0, 0.0, 0.0)
    assert math.isclose(metrics.t_quantile(0.975, 4), 2.776445, abs_tol=1e-5)
    long = spark.createDataFrame([(i, "m", v) for i, v in enumerate([0.1, 0.2, 0.25, 0.3, 0.9])] + [(9, "one", 0.5), (10, "m", float("nan"))], "seed int, model string, value double").withColumn("metric", F.lit("auc"))
    b = {r["model"]: r for r in metrics.bca_intervals(long, ["model"], 199).collect()}
    assert b["m"]["ci_low"] < b["m"]["mean"] < b["m"]["ci_high"] and b["one"]["ci_low"] == b["one"]["ci_high"] == 0.5
    perfect = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "label string, cluster int")
    assert tuple(metrics.clustering_agreement(perfect).first()) == (1.0, 1.0)


def vectors_of(spark, n=40, dim=8):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(f"w{i}", rng.standard_normal(dim).tolist()) for i in range(n)], "word string, vec array<double>")


def test_search_and_layers(spark):
    v = vectors_of(spark)
    near = search.nearest_words(v, ["w0", "nope"], 3).toPandas()
    assert len(near) == 3 and "w0" not in set(near.neighbour)
    e = spark.createDataFrame([("w0", "w1"), ("w2", "w1"), ("w1", "w3")], "src string, dst string")
    m = {r["word"]: np.array(r["vec"]) for r in v.collect()}
    s = {r["word"]: np.array(r["vec"]) for r in layers.sage_mean(v, e, 8).collect()}
    assert np.allclose(s["w1"], (m["w0"] + m["w2"]) / 2) and np.allclose(s["w0"], 0)
    a = layers.attention(v, e, [1.0] * 8, 8).toPandas()
    assert np.allclose(a.groupby("dst").alpha.sum(), 1)
    r = layers.rgcn(v, e.withColumn("etype", F.lit(0)), 8, np.eye(8).tolist(), [np.eye(8).tolist()], {0: [1.0]})
    r = {x["word"]: np.array(x["vec"]) for x in r.collect()}
    assert np.allclose(r["w3"], m["w3"] + m["w1"])
    n = v.select(layers.layer_norm(F.col("vec")).alias("x")).first()["x"]
    assert abs(np.mean(n)) < 1e-9 and abs(np.std(n) - 1) < 1e-3
    c = layers.char_cnn(spark.createDataFrame([("a", [1, 2]), ("b", None)], "word string, ids array<int>"), {3: np.ones((2, 3, 4)), 5: np.ones((2, 5, 4))}, np.ones((5, 4))).toPandas()
    assert all(len(x) == 4 for x in c.vec)
    known = spark.createDataFrame([("w0", "w1"), ("w0", "w2")], "source string, target string")
    ranks = search.filtered_ranks(known, known, v, 20).toPandas()
    assert ranks["rank"].between(1, 21).all() and len(ranks) == 2


def test_ranks_read_their_index_once(spark):
    v = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(9)], "word string, vec array<double>")
    known = spark.createDataFrame([("w1", "w2"), ("w3", "w4")], "source string, target string")
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            made.add(len(x))
            yield x

    r = search.filtered_ranks(known, known, v.mapInPandas(counted, v.schema), 20)
    assert {(x["source"], x["target"]): x["rank"] for x in r.collect()} == {("w1", "w2"): 7, ("w3", "w4"): 5}
    assert made.value == 9


def test_training(spark):
    v = vectors_of(spark, 30, 6)
    pos = spark.createDataFrame([(f"w{i}", f"w{(i + 1) % 30}") for i in range(30)], "source string, target string")
    neg = pos.withColumn("negative", F.concat(F.lit("w"), ((F.substring("source", 2, 3).cast("int") + 11) % 30).cast("string")))
    val = pos.withColumn("label", F.lit(1)).unionByName(neg.select("source", F.col("negative").alias("target"), F.lit(0).alias("label")))
    m = training.train_link_predictor(pos, neg, v, val, 6, out=6, epochs=6, rate=0.05, every=6)
    assert m.losses[-1] < m.losses[0] and m.best_auc > 0.4
    rows = v.select(F.col("vec").alias("x"), F.when(F.get("vec", F.lit(0)) > 0, 1).otherwise(0).alias("y"))
    _, losses = training.train_head(rows, 6, 2, epochs=4)
    assert losses[-1] < losses[0]
    b = {"u": np.ones((3, 2)), "v": np.ones((3, 2)) * 2, "w": np.ones((3, 2))}
    p = {"ws": np.array([[0.1, 0.2], [0.3, 0.1]]), "wt": np.array([[0.2, 0.1], [0.1, 0.4]])}
    loss, g = training.bilinear_bpr(p, b)
    q = {k: x.copy() for k, x in p.items()}
    q["ws"][0, 1] += 1e-6
    assert math.isclose((training.bilinear_bpr(q, b)[0] - loss) / 1e-6, g["ws"][0, 1], rel_tol=1e-3)


def test_embeddings(spark):
    v = vectors_of(spark, 30, 6)
    assert len(embed.pca(v, 2, 4).first()["vec"]) == 4
    assert embed.kmeans(v, 3, 2).select("cluster").distinct().count() <= 3
    assert embed.subword_embedding(v, spark.createDataFrame([("w1x",)], "word string"), 6).count() == 1
    t = embed.text_embedding(spark.createDataFrame([("a", "b c")], "word string, definition_hy string"), embed.hashed_text_provider(16), 16).first()
    assert math.isclose(sum(x * x for x in t["vec"]), 1, rel_tol=1e-6)
    y = embed.tsne(v, most=20, steps=30).toPandas()
    assert len(y) == 20 and y[["x", "y"]].notna().all().all()
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "source string, target string")
    assert embed.walk_embedding(e, 2, 5, 4).count() >= 2


def test_walk_vectors(spark):
    from collections import Counter

    from derivagraph.operators import skipgram

    rng = random.Random(4)
    links = {(f"{a}{x}", f"{a}{(x + rng.choice([1, 1, 2, 5])) % 12}") for a in "abc" for x in range(12) for _ in range(3)} | {("b3", "b3"), ("c1", "end"), ("only", "end")}
    e = spark.createDataFrame(sorted(links), "source string, target string")
    words = sorted({w for x in links for w in x})
    ids = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, id long")
    starts, sc = e.select(F.col("source").alias("word")), Scratch(spark)
    want = Counter()
    for r in graph.random_walks(e, starts, 4, 9, 7, sc).collect():
        path = [words.index(w) for w in r["path"]]
        want[path[0], path[0]] += 0
        for i, x in enumerate(path):
            for d in range(1, 4):
                if i + d < len(path):
                    want[min(x, path[i + d]), max(x, path[i + d])] += 4 - d
    for packed in (1000, 0):  # walks in every task, and by joins
        assert {(r["a"], r["b"]): r["n"] for r in skipgram.walk_counts(e, ids, 4, 9, 3, 7, sc, packed).collect()} == dict(want)
    counts = sc.cut(skipgram.walk_counts(e, ids, 10, 20, 3, 7, sc).withColumn("n", F.col("n") / 3))
    for blocks in (1, 3):
        rows = skipgram.skip_gram(counts, len(words), 8, 2, 7, sc, blocks).collect()
        assert sorted(r["id"] for r in rows) == list(range(len(words)))
        v = {words[r["id"]]: np.array(r["vec"]) / np.linalg.norm(r["vec"]) for r in rows}
        near, far = ([v[x] @ v[y] for x in v for y in v if x != y and x[0] in "abc" and y[0] in "abc" and (x[0] == y[0]) == same] for same in (True, False))
        assert np.isfinite(near).all() and np.mean(near) > np.mean(far) + 0.3
    assert {r["word"] for r in embed.walk_embedding(e, 4, 9, 8).collect()} == set(words)
    assert embed.walk_embedding(e, 1, 1, 8).count() == len({x for x, _ in links})  # walks of their start only
    assert embed.walk_embedding(e.limit(0), 4, 9, 8).count() == 0
    g = np.random.default_rng(1)
    a = [g.normal(size=(n, 3)) for n in (4, 4, 5)]
    w, own = g.random(4), g.random((4, 5)) < 0.3
    log = lambda x: np.log(1 / (1 + np.exp(-x)))
    loss = lambda x, y, z: (w * log((x * y).sum(1))).sum() + (w[:, None] * skipgram.NEGATIVES / 5 * log(-(x @ z.T)) * ~own).sum()
    for k, d in enumerate(skipgram.gradients(*a, w, own)):
        for at in np.ndindex(d.shape):
            b = [x.copy() for x in a]
            b[k][at] += 1e-6
            assert math.isclose((loss(*b) - loss(*a)) / 1e-6, d[at], rel_tol=1e-3, abs_tol=1e-5)


def test_crawl_and_sources(spark, tmp_path):
    lex = spark.createDataFrame(WORDS, "word string, pos string")
    pg = spark.createDataFrame([("գիր", PAGE), ("գրագետ", None)], "word string, page string")
    edges, seen = crawl.crawl(pg, spark.createDataFrame([("գիր",)], "word string"), lex, Scratch(spark), max_rounds=2)
    assert {"գիր", "գրագետ"} <= {r["word"] for r in seen.collect()}
    assert edges.columns == derive.EDGE
    d = runs.run_dir(str(tmp_path))
    assert runs.run_dir(str(tmp_path), resume=True) == d
    runs.append(lex, f"{d}/t")
    runs.append(lex, f"{d}/t")
    assert spark.read.parquet(f"{d}/t").count() == 2 * len(WORDS)
    runs.export_csv(spark.createDataFrame([("a\"b", None, "x,y", "", "", "", "", "")], runs.NODE_SCHEMA), f"{d}/csv")
    assert runs.read_csv(spark, f"{d}/csv", runs.NODE_SCHEMA).first()["word"] == 'a"b'
    (d / "c.yaml").write_text("a: 1\nm:\n  gcn:\n    dims: [1, 2.5]\n    on: true # x\n")
    assert runs.load_config(str(d / "c.yaml"), {"a": 3}) == {"a": 3, "m": {"gcn": {"dims": [1, 2.5], "on": True}}}
    runs.save_results({"x": np.float64(1.5), "n": float("nan"), "v": np.arange(2)}, str(d / "r.json"))
    assert '"n": null' in (d / "r.json").read_text()
    assert runs.flatten({"a": {"b": 1, "c": "x"}, "d": 2.0}) == [("a/b", 1.0), ("d", 2.0)]
    (d / "w.dic").write_text("2\nբառ/A\n գիր \n\n")
    assert {r["word"] for r in pages.dictionary(spark, str(d / "w.dic")).collect()} == {"բառ", "գիր"}
    calls = []

    def fail(*a, **k):
        calls.append(1)
        raise OSError

    assert pages.ask("http://none", ["a"], opener=fail, sleep=lambda s: None) is None and len(calls) == 3
    answer = {"query": {"normalized": [{"from": "x y", "to": "X y"}], "pages": {"1": {"title": "X y", "ns": 0, "revisions": [{"slots": {"main": {"*": "body"}}}]}, "2": {"title": "t", "ns": 1, "revisions": [{"*": "talk"}]}, "-1": {"title": "m", "ns": 0, "missing": ""}, "3": {"title": "o", "ns": 0, "revisions": [{"*": "old"}]}}}}
    found = spark.createDataFrame([(["x y", "t", "m", "o"], json.dumps(answer)), (["n"], None), (["e"], "{}")], "words array<string>, answer string")
    got = {r["word"]: (r["page"], r["answered"]) for r in pages.parsed(found).collect()}
    assert got == {"x y": ("body", True), "t": (None, True), "m": (None, True), "o": ("old", True), "n": (None, False), "e": (None, True)}
    asked = pages.answers(spark.createDataFrame([(f"w{i:03}",) for i in range(120)] + [(None,), ("w000",)], "word string"), "http://none", opener=fail, sleep=lambda s: None)
    assert sorted(len(r["words"]) for r in asked.collect()) == [20, 50, 50]


def test_stream(spark, tmp_path):
    from derivagraph.streaming.landed import derive_stream, page_stream

    spark.createDataFrame([("գիր", PAGE)], "word string, page string").withColumn("fetched_at", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    q = derive_stream(page_stream(spark, str(tmp_path / "in")), spark.createDataFrame(WORDS, "word string, pos string"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def dense_loss(kind, p, x, links, pairs, dim_hid, heads):
    """Loss of a two-layer model by plain loops over nodes and links."""
    n = len(x)
    into = {i: [] for i in range(n)}
    for s, d, t in links:
        into[d].append((s, t))
    if kind in ("gcn", "gat"):
        for i in range(n):
            into[i].append((i, 0))

    def layer(h, name, heads):
        out = []
        for i in range(n):
            if kind == "gcn":
                agg = sum((h[j] / np.sqrt(len(into[i]) * len(into[j])) for j, _ in into[i]), np.zeros(h.shape[1]))
                out.append(p[name + "w"] @ agg + p[name + "b"])
            elif kind == "sage":
                agg = np.mean([h[j] for j, _ in into[i]], 0) if into[i] else np.zeros(h.shape[1])
                out.append(p[name + "w"] @ agg + p[name + "b"] + p[name + "self"] @ h[i])
            elif kind == "rgcn":
                y = p[name + "b"] + p[name + "self"] @ h[i]
                bases = np.split(p[name + "w"], p[name + "mix"].shape[1], axis=1)
                for t in {t for _, t in into[i]}:
                    w = sum(c * b for c, b in zip(p[name + "mix"][t], bases, strict=True))
                    y = y + w @ np.mean([h[j] for j, u in into[i] if u == t], 0)
                out.append(y)
            else:
                width = p[name + "a"].shape[1]
                wl, wr = np.split(p[name + "lr"], 2)
                y = p[name + "b"] * 1.0
                near = sorted({j for j, _ in into[i]})
                for k in range(heads):
                    l, r = wl[k * width : (k + 1) * width], wr[k * width : (k + 1) * width]
                    e = np.array([p[name + "a"][k] @ np.where((z := l @ h[j] + r @ h[i]) > 0, z, 0.2 * z) for j in near])
                    a = np.exp(e - e.max())
                    y = y + sum(q * (l @ h[j]) for q, j in zip(a / a.sum(), near, strict=True)) / heads
                out.append(y)
        return np.array(out)

    h = np.maximum(layer(x, "c1", heads), 0)
    h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5)
    z = layer(np.concatenate([h, x], 1), "c2", 1)
    z = z / np.linalg.norm(z, axis=1, keepdims=True)
    sc = lambda u, v: (p["ws"] @ z[u]) @ (p["wt"] @ z[v])
    return float(np.mean([np.log1p(np.exp(-(sc(u, v) - sc(u, w)))) for u, v, w in pairs]))


@pytest.mark.parametrize("kind", models.KINDS)
def test_models_gradients(spark, kind):
    rng = np.random.default_rng(11)
    n, feat, hid, out = 7, 3, 4, 3
    x = rng.standard_normal((n, feat))
    links = [(a, b, t) for a, b, t in {(int(rng.integers(n)), int(rng.integers(n)), int(rng.integers(2))) for _ in range(12)} if a != b]
    if kind == "gat":
        links = list({(a, b): (a, b, t) for a, b, t in links}.values())
    pairs = [(0, 1, 2), (3, 4, 5), (6, 0, 3)]
    nodes = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, vec array<double>")
    sc = Scratch(spark)
    m = models.Encoder(nodes, spark.createDataFrame(links, "src long, dst long, etype int"), kind, feat, hid, out, sc, types=2, heads=2, bases=2, seed=5)
    z = m.encode()
    loss, grads, dz = models.link_gradient(z, spark.createDataFrame(pairs, "u long, v long, w long"), m.p, out, sc)
    grads |= m.gradient(dz)
    assert math.isclose(loss, dense_loss(kind, m.p, x, links, pairs, hid, 2), rel_tol=1e-9)
    assert set(grads) == set(m.p)
    for k, g in grads.items():
        at = np.unravel_index(int(rng.integers(g.size)), g.shape)
        old, eps = m.p[k][at], 1e-5
        m.p[k][at] = old + eps
        up = dense_loss(kind, m.p, x, links, pairs, hid, 2)
        m.p[k][at] = old - eps
        down = dense_loss(kind, m.p, x, links, pairs, hid, 2)
        m.p[k][at] = old
        assert math.isclose(g[at], (up - down) / (2 * eps), rel_tol=1e-4, abs_tol=1e-7), k


@pytest.mark.parametrize("kind, epochs", [("sage", 2), ("gcn", 1), ("rgcn", 1)])
def test_epochs_in_one_stage_are_those_of_tables(spark, kind, epochs, monkeypatch):
    """Losses, AUCs and parameters are those of ``models.train``; few columns and pairs at a time."""
    monkeypatch.setattr(fullbatch, "COLUMNS", 1)
    monkeypatch.setattr(fullbatch, "PAIRS", 5)
    rng = np.random.default_rng(4)
    n = 40
    nodes = [(i, [int(rng.integers(3)), int(rng.integers(2))], rng.integers(0, 12, int(rng.integers(0, 40))).tolist()) for i in range(n)]
    links = sorted({(int(rng.integers(n)) // 2, int(rng.integers(n)), int(rng.integers(3))) for _ in range(90)} | {(0, i, 0) for i in range(n - 3)})
    links = [x for x in links if x[0] != x[1]]
    nodes = spark.createDataFrame(nodes, "id long, cat array<int>, tri array<int>")
    labels = spark.createDataFrame([(i, i % 3 - 1) for i in range(n)], "id long, label int")
    kept = spark.createDataFrame(links, "source long, target long, etype int")
    both = spark.createDataFrame([(u, v, t) for u, v, t in links] + [(v, u, t + 3) for u, v, t in links], "src long, dst long, etype int")
    words = labels.select(F.col("id").cast("string").alias("word"), F.when(F.col("label") < 0, "unknown").otherwise(F.col("label").cast("string")).alias("pos"))
    val = spark.createDataFrame([(i, (7 * i + 3) % n, i % 2) for i in range(n)], "source long, target long, label int")

    def pairs_of(epoch):
        x = sampling.hard_negatives(kept.select(F.col("source").cast("string"), F.col("target").cast("string")), words, seed=42 + epoch).filter("valid")
        p = kept.join(x.select(*[F.col(k).cast("long").alias(k) for k in ("source", "target", "negative")]), ["source", "target"])
        return p.select(F.col("source").alias("u"), F.col("target").alias("v"), F.col("negative").alias("w"), "etype")

    more = {"every": 1, "types": 3, "labels": labels, "parts": 2}
    of = lambda: models.Encoder(nodes, both, kind, 20, 18, 10, Scratch(spark), types=6 if kind == "rgcn" else 1, bases=2, labels=[3, 2], trigrams=10)
    a, b = of(), of()
    want = models.train(a, pairs_of, val, epochs, **more)
    got = fullbatch.train(b, kept, words, val, epochs, tasks=3, real="float64", **more)
    assert np.allclose(got.losses, want.losses, rtol=1e-9) and np.allclose(got.aucs, want.aucs, atol=2e-6)
    assert set(a.p) == set(b.p) and all(np.allclose(a.p[k], b.p[k], rtol=1e-6, atol=1e-8) for k in a.p)


@pytest.mark.parametrize("name, widths", [("j3_train_gcn", (128, 256, 128, 1)), ("j4_train_sage", (64, 128, 64, 1)), ("j6_train_rgcn", (64, 256, 64, 32))])
def test_training_queries_run_all_epochs_at_their_widths(monkeypatch, name, widths):
    """What the query asks of the training: 200 epochs and the published widths (features, hidden, output, bases)."""
    asked = []

    def training_of(spark, d, kind, epochs, feat=128, hid=256, out=128, bases=1):
        asked.append((epochs, (feat, hid, out, bases)))
        return None, models.Trained({}), None

    monkeypatch.setattr(reference_queries, "_training", training_of)
    monkeypatch.setattr(reference_queries, "_history", lambda spark, t: t)
    reference_queries.QUERIES[name](None, "")
    assert asked == [(200, widths)]


def test_row_local_functions_see_few_rows_at_once(spark):
    rows = spark.range(3000, numPartitions=1).select("id", F.array(F.col("id").cast("double")).alias("vec"))
    got = models.forward(rows, ["vec"], {}, lambda p, x, i: tape.as_t(x["vec"] * 0.0 + len(i))).select("id", F.col("vec")[0].alias("n")).collect()
    assert len({r["id"] for r in got}) == 3000 and max(r["n"] for r in got) <= 256
    one = {"w": np.ones((1, 1))}
    _, g, loss = models.backward(rows, ["vec"], {"vec": "id"}, one, lambda p, x, i: tape.as_t(x["vec"]).apply(p["w"]).sum(), Scratch(spark))
    assert loss == g["w"][0, 0] == sum(range(3000))


def test_row_local_gradients():
    """Embedder, heads and ensemble modes against finite differences."""
    rng = np.random.default_rng(2)
    ids = np.arange(5)
    two = lambda a, b: rng.standard_normal((a, b)) * 0.5
    emb = {"cat0": two(3, 16), "cat1": two(2, 16), "tri": two(9, 32), "conv3": two(32, 96), "conv3b": np.full(32, 0.1), "conv5": two(32, 160), "conv5b": np.full(32, 0.1), "proj": two(4, 96), "projb": np.full(4, 0.1)}
    feats = {"cat": rng.integers(0, 2, (5, 2)), "tri": np.array([[1, 2, 3], [], [4] * 40, None, [8, 1]], dtype=object)}
    vecs = {c: two(5, 3) for c in ("u", "v", "w", "vec")} | {"etype": np.array([0, 1, -1, 2, 0]), "label": np.array([1, 0, -1, 1, 1])}
    heads = {"ws": two(3, 3), "wt": two(3, 3), **models.head_params(3, 3, 2)}
    both = {"gnn": two(5, 3), "aux": two(5, 2)}
    cases = [(emb, feats, lambda p, x, i: models.embed(p, x, i, 0.3, 7)), (heads, vecs, lambda p, x, i: models.pair_loss(p, x, i, 0.3)), (heads, vecs, models.pos_loss)]
    cases += [(models.ensemble_params(mode, 3, 2, 4), both, lambda p, x, i, mode=mode: models.mixed(p, x, i, mode)) for mode in models.MODES]
    for params, x, fn in cases:
        t = {k: tape.T(v.copy()) for k, v in params.items()}
        y = fn(t, x, ids)
        up = rng.standard_normal(y.shape)
        tape.gradients(y, up)
        value = lambda: float((fn({k: tape.T(v) for k, v in params.items()}, x, ids).v * up).sum())  # noqa: E731, B023
        for k in params:
            if t[k].g is None:
                continue
            at = np.unravel_index(int(rng.integers(params[k].size)), params[k].shape)
            old = params[k][at]
            params[k][at] = old + 1e-6
            a = value()
            params[k][at] = old - 1e-6
            b = value()
            params[k][at] = old
            assert math.isclose(t[k].g[at], (a - b) / 2e-6, rel_tol=1e-3, abs_tol=1e-6), k


def test_biased_walks(spark):
    e = spark.createDataFrame([(a, b) for x in ("ab", "bc", "ca", "cd", "de") for a, b in (x, x[::-1])], "source string, target string")
    starts = e.select(F.col("source").alias("word")).distinct()
    edges = {(r["source"], r["target"]) for r in e.collect()}

    def returns(p, q):
        w = [r["path"] for r in graph.random_walks(e, starts, 12, 4, 3, Scratch(spark), p, q).collect()]
        assert len(w) == 60 and all(len(x) == 4 and all(s in edges for s in zip(x, x[1:], strict=False)) for x in w)
        return sum(x[i] == x[i + 2] for x in w for i in range(2))

    assert returns(0.25, 1.0) > 1.2 * returns(4.0, 1.0)
    sink = spark.createDataFrame([("x", "y")], "source string, target string")
    got = graph.random_walks(sink, sink.select(F.col("source").alias("word")), 2, 4, 1, Scratch(spark), 0.5, 2.0).collect()
    assert sorted((r["walk"], r["path"]) for r in got) == [(0, ["x", "y"]), (1, ["x", "y"])]


def test_ranks_and_order_statistics(spark):
    from derivagraph.operators.ranks import numbered, running_sums, smallest

    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randint(0, 50), i, "x") for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v int, k int, i2 string")
    want, seen = {}, {}
    for g, v, k, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        want[k] = seen.get(g, 0)
        seen[g] = want[k] + 1
    got = {r["k"]: (r["i"], r["n"]) for r in numbered(df, ["g"], ["v", "k"], "i", "n").collect()}
    assert got == {k: (want[k], seen[g]) for g, _, k, _ in rows}
    assert numbered(df.limit(0), [], ["v"]).count() == 0
    run = running_sums(df, F.struct((-F.col("v")).alias("v"), "k"), {"s": "v"}).collect()
    total = 0
    for r in sorted(run, key=lambda r: (-r["v"], r["k"])):
        total += r["v"]
        assert r["s"] == total and r["s_all"] == sum(x[1] for x in rows)
    big = [rng.getrandbits(60) for _ in range(300)] + [7] * 5
    d = spark.createDataFrame([(x,) for x in big] + [(None,)], "h long")
    assert [smallest(d, "h", k, few=3) for k in (1, 5, 6, 150, 305)] == [sorted(big)[k - 1] for k in (1, 5, 6, 150, 305)] and smallest(d, "h", 306) is None
