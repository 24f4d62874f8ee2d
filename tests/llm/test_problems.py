"""Training-data operators against brute force on small tables with nulls, blanks, ties, repeats and clashing columns."""

import itertools
import math
import random
import unicodedata

import numpy as np
import pytest
from derivagraph.functions.spelling import to_plain
from derivagraph.llm import clusters, family_split, leakage, lookalike, mixture, neighbours, overlap, reading
from derivagraph.scratch import Scratch

NAMES = [("root_compound", "root_compound", "compounding", None), ("nominalization", "nominalization", "suffixation", None), ("denominal_base", "denominalization", "inverse_suffixation", "nominalization")]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(NAMES, "label_name string, canonical string, relation_class string, inverse_of string")


def one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


SAMPLE = "sample_id long, split string, source string, relation string, target string, label int, cid string, a string"


def brute_pairs(rows):
    ok = [(i, s, to_plain(x), (r or "").strip().lower(), to_plain(y)) for i, s, x, r, y, *_ in rows if all(isinstance(v, str) and v for v in (s, x, r, y)) and s in ("train", "val", "test")]
    out = set()
    for p, q in itertools.product(ok, ok):
        if p[1] == "train" and q[1] != "train" and p[3] == q[3] and ((p[2] == q[2] and one_edit(p[4], q[4])) or (p[4] == q[4] and one_edit(p[2], q[2]))):
            out.add((min(p[0], q[0]), max(p[0], q[0])))
    return out


def test_overlaps_equal_brute_force_with_a_hot_anchor(spark, names, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_PAIRS", 20)  # the hot way runs too
    rng = random.Random(3)
    letters = "աբգդե"
    rows = []
    for i in range(260):
        src = "նորաշ" if rng.random() < 0.4 else "".join(rng.choices(letters, k=rng.randint(1, 4)))
        dst = ("նորաշ" if src == "նորաշ" else "") + "".join(rng.choices(letters, k=rng.randint(1, 3)))
        rows.append((i, rng.choice(["train", "train", "val", "test"]), src, rng.choice(["root_compound", " ROOT_COMPOUND", "nominalization"]), dst, 1, "x", "y"))
    rows += [(900, None, "ա", "nominalization", "բ", 1, "", ""), (901, "train", None, "nominalization", "բ", None, None, None), (902, "val", "ա", "", "բ", 0, "", ""), (903, "val", rows[0][2], rows[0][3], rows[0][4], 0, "", "")]
    df = spark.createDataFrame(rows, SAMPLE)
    found = overlap.overlaps(overlap.records(df, names))
    matches = found[2]
    got = [tuple(r) for r in overlap.overlap_pairs(*found).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(rows)
    cov = matches.select("coverage").toPandas().coverage
    assert ((cov > 0) & (cov <= 1)).all()
    rep = overlap.overlap_report(*found).toPandas()
    assert rep.n_rows.sum() == sum(1 for r in rows if r[1] in ("val", "test") and r[2] and r[3])


def test_overlaps_of_nothing(spark, names):
    found = overlap.overlaps(overlap.records(spark.createDataFrame([], SAMPLE), names))
    assert found[2].count() == overlap.overlap_pairs(*found).count() == overlap.overlap_report(*found).count() == 0


def test_coverage_counts_matched_letters(spark, names):
    rows = [(1, "train", "աբգդ", "nominalization", "ե"), (2, "val", "աբգ", "nominalization", "ե"), (3, "test", "աբգդզ", "nominalization", "ե"), (4, "test", "աբգէ", "nominalization", "ե"), (5, "val", "աբգդ", "nominalization", "ե")]
    df = spark.createDataFrame([(*r, 1, "", "") for r in rows], SAMPLE)
    _, _, m = overlap.overlaps(overlap.records(df, names))
    assert {r["b"]: round(r["coverage"], 6) for r in m.collect()} == {2: 1.0, 3: round(5 / 6, 6), 4: 0.8, 1: 1.0}


def test_winnowing_equals_brute_force():
    rng = random.Random(2)
    texts = ["".join(rng.choices("աբգ", k=rng.choice([0, 1, 2, 3, 5, 9, 40, 700]))) for _ in range(60)]
    i, h, at = overlap.winnow(texts)
    got = {}
    for a, b, c in zip(i.tolist(), h.tolist(), at.tolist(), strict=True):
        got.setdefault(a, set()).add((b, c))
    for k, t in enumerate(texts):
        p = "\x02" + t + "\x03"
        grams = [int(overlap._mixed(np.array([ord(p[x])], np.uint64), np.array([ord(p[x + 1])], np.uint64))[0]) for x in range(len(p) - 1)]
        w = max(1, (len(t) - 2) // 2)
        want = set()
        for s in range(len(grams) - w + 1):
            best = min(range(s, s + w), key=lambda x: (grams[x] >> 24, x))
            want.add((grams[best], best))
        assert got[k] == (want | {(0, 0)} if len(t) <= 1 else want)


def test_plain_forms_agree_with_the_word_function(spark):
    marks = ["é", "é", "ո́̆", "ｆüｌａ", "нyбёкeй", "լаｕ", "", "­", "ա֊բ", "մﬔ", "եւ", " ա  բ ", "ạ́", "ạ́", "ա" * 3000 + "o", "ՆОՐ", "q1", "נ"]
    df = spark.createDataFrame([(w, 1) for w in [*marks, None, marks[0]]], "written string, plain int")
    got = {r["written"]: r["plain"] for r in lookalike.plain_forms(df).collect()}
    assert got == {w: to_plain(w) for w in marks}
    assert all(unicodedata.normalize("NFC", v) == v for v in got.values())
    assert all(to_plain(v) == v for v in got.values())
    changed = {r["written"] for r in lookalike.not_plain(df).collect()}
    assert changed == {w for w in marks if to_plain(w) != w}
    assert lookalike.plain_forms(df.limit(0)).count() == 0


def vectors(n, seed, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 5, dim))
    v = np.concatenate([base + 0.2 * rng.standard_normal(base.shape) for _ in range(4)] + [rng.standard_normal((n - 4 * (n // 5), dim))]).astype(np.float32)
    v[5] = v[0]
    v[6] = v[0] * 2
    return v


def vector_frame(spark, v, extra=()):
    cols = [f"c{i}" for i in range(v.shape[1])]
    rows = [(i, "w", *map(float, r)) for i, r in enumerate(v)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, word string, " + ", ".join(f"{c} float" for c in cols)), cols


def brute_cos(v):
    u = v.astype(np.float64)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    return s


def test_neighbours_recall_and_ties(spark):
    v = vectors(1200, 1)
    bad = [(5000, "n", *[None] * 64), (5001, "n", *[float("nan")] * 64), (5002, "n", *[0.0] * 64)]
    df, cols = vector_frame(spark, v, bad)
    ix = neighbours.Index(neighbours.vector_table(df, cols), leaf=150)
    assert ix.depth == 3 and ix.n == 1198
    got = {}
    for r in neighbours.nearest(ix).collect():
        got.setdefault(r["vec_id"], []).append((-r["cos"], r["neighbour"]))
    s = brute_cos(v)
    hit = total = 0
    for i in range(len(v)):
        c = np.flatnonzero(s[i] >= 0.87)
        want = c[np.lexsort((c, -s[i][c]))][:5].tolist()
        have = [x for _, x in sorted(got.get(i, []))]
        assert len(have) <= 5 and i not in have
        hit += len(set(want) & set(have))
        total += len(want)
    assert total > 1000 and hit / total >= 0.97
    assert got[0][0][0] == -1.0 and {x for _, x in got[0]} >= {5, 6}


def test_clusters_equal_the_linked_sets(spark, monkeypatch):
    v = vectors(600, 2)
    df, cols = vector_frame(spark, v)
    monkeypatch.setattr(neighbours, "CHUNK", 60)  # leaves are cut to chunks
    ix = neighbours.Index(neighbours.vector_table(df, cols), leaf=200)
    c = clusters.Clustering(ix)
    got = sorted(tuple(r) for r in c.sets().collect())
    s = brute_cos(v) >= 0.87
    seen, want = set(), []
    for i in range(len(v)):
        if i in seen:
            continue
        part, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(s[todo.pop()]):
                if j not in part:
                    part.add(int(j))
                    todo.append(int(j))
        seen |= part
        if len(part) >= 3:
            want += [(min(part), j) for j in part]
    assert got == sorted(want)
    members = c.members()
    assert (members.toPandas().flow >= 0).all()
    words = spark.createDataFrame([(i, f"w{i}") for i in range(len(v))], "vec_id long, word string")
    told = clusters.describe_clusters(members, words, spark.createDataFrame([("w0", "noun")], "word string, pos string")).toPandas()
    assert (told.n_members >= 3).all() and told.typical_words.str.len().gt(0).all()


def brute_flow(w, rounds, inflation=2.0, prune=1e-3):
    """Markov clustering column by column: the flow matrix after ``rounds`` squarings."""
    n = len(w)
    m = [[w[i][j] if i != j else (max(w[j]) or 1.0) for j in range(n)] for i in range(n)]

    def scaled(m, keep=0.0):
        out = [[0.0] * n for _ in range(n)]
        for j in range(n):
            t = sum(m[i][j] for i in range(n))
            col = [m[i][j] / t if m[i][j] / t >= keep else 0.0 for i in range(n)]
            t = sum(col)
            for i in range(n):
                out[i][j] = col[i] / t
        return out

    m = scaled(m)
    for _ in range(rounds):
        sq = [[sum(m[i][k] * m[k][j] for k in range(n)) ** inflation for j in range(n)] for i in range(n)]
        m = scaled(scaled(sq), prune)
    return np.array(m)


def test_flow_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 14
    w = np.triu((rng.random((n, n)) < 0.25) * rng.integers(1, 6, (n, n)), 1).astype(float)
    w[0, 1] = 3.0
    w = w + w.T
    m = brute_flow(w.tolist(), clusters.EXPANSIONS)
    links = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(i + 1, n) if w[i, j]], "a long, b long, w double")
    got = {r["node"]: r["name"] for r in clusters.attractors(links, Scratch(spark)).collect()}
    hub = np.round(m, 9).argmax(0)
    want = {j: int(min(hub[j], j) if hub[hub[j]] == j else hub[j]) for j in range(n) if w[j].any()}
    assert got == want and len(set(got.values())) > 1
    h, f = clusters.dense_flow(w[None], rounds=clusters.EXPANSIONS)
    assert h[0].tolist() == [want.get(j, j) for j in range(n)]
    assert np.allclose(f[0], brute_flow(w.tolist(), 1).sum(1), atol=1e-4)


def test_linked_clusters_of_any_shape(spark):
    rng = random.Random(8)
    links = [(i, i + 1, 1.0) for i in range(0, 300)] + [(1000, 1000 + i, 0.5) for i in range(1, 1500)]  # a chain, and a hub with equal links to more rows than a column keeps
    links += [(3000 + rng.randrange(200), 3000 + rng.randrange(200), rng.random() + 0.1) for _ in range(180)] + [(7, 8, 1.0), (None, 1, 1.0), (5, None, 1.0), (9000, 9001, 0.0), (9002, 9002, 1.0)]
    g = spark.createDataFrame(links, "a long, b long, w double")
    part = {}
    for r in clusters.linked_clusters(g, Scratch(spark)).collect():
        part.setdefault(r["name"], set()).add(r["node"])
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b, w in links:
        if a is not None and b is not None and a != b and w > 0:
            up[root(a)] = root(b)
    want = {}
    for x in list(up):
        want.setdefault(root(x), set()).add(x)
    assert sorted(map(sorted, part.values())) == sorted(map(sorted, want.values()))
    assert clusters.linked_clusters(g.limit(0), Scratch(spark)).count() == 0


def test_leaf_blocks_join_what_they_cut():
    rng = np.random.default_rng(5)
    m = rng.standard_normal(8) + 0.05 * rng.standard_normal((90, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    adj = np.ones((90, 90), bool) & ~np.eye(90, dtype=bool)
    hub, flow, between = clusters.leaf_attractors(m, adj, block=20)
    names = set(hub.tolist())
    assert len(names) >= 5 and (flow > 0).any() and {x for a, b, _ in between for x in (a, b)} == names


def test_cluster_report_tells_whole_linked_sets(spark, tmp_path):
    from derivagraph.llm import queries

    v = np.zeros((66, 64), np.float32)
    for i in range(60):  # a chain: each vector is linked to the ones before and after only, so the flow splits what links hold together
        v[i, i // 4], v[i, i // 4 + 1] = np.cos(i % 4 * np.pi / 8), np.sin(i % 4 * np.pi / 8)
    v[60:63, 40], v[63:65, 45], v[65, 50] = 1, 1, 1
    df, _ = vector_frame(spark, v)
    df.write.parquet(f"{tmp_path}/embeddings_gcn.parquet")
    spark.createDataFrame([(1, "w0", "noun", "2024-01-01")], "node_id long, word string, pos string, scraped_at string").write.parquet(f"{tmp_path}/nodes.parquet")
    got = {r["cluster"]: r["n_members"] for r in queries.p5_clusters(spark, str(tmp_path)).collect()}
    assert got == {0: 60, 60: 3}


def test_vectors_of_nothing(spark):
    df, cols = vector_frame(spark, np.zeros((1, 64), np.float32))
    ix = neighbours.Index(neighbours.vector_table(df, cols))
    assert neighbours.nearest(ix).count() == 0
    assert clusters.Clustering(ix).sets().count() == 0


EDGES = "edge_id long, source string, relation string, target string, label string, family long"


def test_families_and_splits(spark, names):
    rng = random.Random(5)
    rows = [(i, f"ա{rng.randint(0, 400)}", rng.choice(["root_compound", "Nominalization ", "denominal_base", "նոր"]), f"ա{rng.randint(0, 400)}", "z", 1) for i in range(500)]
    rows += [(900, None, "nominalization", "ա", "", 0), (901, "ա", "", "բ", "", 0), (902, "ա1", "nominalization", "ա1", "", 0), (903, *rows[0][1:])]
    sc = Scratch(spark)
    f = sc.cut(family_split.families(spark.createDataFrame(rows, EDGES), names, sc))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    ok = [r for r in rows if r[1] and r[2] and r[3]]
    for _, s, r, t, *_ in ok:
        if r.strip().lower() in ("nominalization", "denominal_base"):
            parent[find(s)] = find(t)
    first = {}
    for i, _, _, t, *_ in sorted(ok):
        first.setdefault(find(t), i)
    assert {(r["edge_id"], r["group_first"]) for r in f.collect()} == {(i, first[find(t)]) for i, _, _, t, *_ in ok}
    a = family_split.split_edges(f, family_split.assign_splits(f, sc)).toPandas()
    assert len(a) == len(ok) and a.groupby("group_first").split.nunique().max() == 1
    many = spark.range(20_000).selectExpr("id AS edge_id", "concat('r', id % 3) AS label", "id - id % 4 AS group_first")
    shares = family_split.split_report(family_split.split_edges(many, family_split.assign_splits(many, sc))).filter("label = ''").toPandas().set_index("split").share
    assert abs(shares["train"] - 0.8) < 0.01 and abs(shares["val"] - 0.1) < 0.01 and abs(shares["test"] - 0.1) < 0.01
    empty = family_split.families(spark.createDataFrame([], EDGES), names, Scratch(spark))
    assert empty.count() == 0


def test_one_giant_family_goes_whole(spark):
    many = spark.range(9_000).selectExpr("id AS edge_id", "'r' AS label", "CASE WHEN id < 3000 THEN 0 ELSE id END AS group_first")
    sc = Scratch(spark)
    a = family_split.split_edges(many, family_split.assign_splits(many, sc)).groupBy("split").count().toPandas().set_index("split")["count"]
    assert abs(a["train"] / 9000 - 0.8) < 0.01


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    voc = [f"բառ{c}" for c in "աբգդեզէըթժիլխ"] + ["և", "է", "Read", "42"]
    items = [(i, " ".join(rng.choices(voc, k=rng.randint(8, 40)))) for i in range(30)]
    docs = []
    for i in range(80):
        w = rng.choices(voc, k=rng.randint(0, 60))
        if i % 2:
            s = rng.choice(items)[1].split()
            n = rng.randint(10, 14)
            w[5:5] = s[:n]
        docs.append((i, "».\n— ".join(x.upper() if rng.random() < 0.2 else x.replace("ա", "ա​") for x in w)))
    docs += [(500, None), (501, ""), (502, items[0][1] * 200), (502, items[0][1] * 200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(d, it).collect()}
    grams = {i: {tuple(w[k : k + 12]) for k in range(len(w) - 11)} for i, w in ((i, leakage.words_of(t)) for i, t in items)}
    want = set()
    for i, t in docs:
        w = leakage.words_of(t or "")
        own = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(i, j) for j, g in grams.items() if g & own}
    assert want and got == want
    assert leakage.leaked_items(d.limit(0), it).count() == leakage.leaked_items(d, it.limit(0)).count() == 0
    monkeypatch.setattr(leakage, "MAX_WORDS", 200)  # several indexes
    monkeypatch.setattr(leakage, "TOGETHER", 3)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(d, it).collect()} == want


def test_many_items_make_one_sparse_index():
    rng = random.Random(4)
    voc = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(voc, k=40))) for i in range(20_000)]
    ix = leakage.ItemIndex(items)
    assert ix.impact.nbytes + ix.keys.nbytes + ix.grams.nbytes + ix.gram_at.nbytes + ix.tok.nbytes < 60 * len(ix.tok)
    text = [*rng.choices(voc, k=500), *items[77][1].split()[3:16], *rng.choices(voc, k=30), *items[5000][1].split()[:11], *rng.choices(voc, k=40_000)]
    assert ix.leaks(np.array([ix.terms.get(w, -1) for w in text], np.int32)) == {77: 13}


def test_pfair_stays_within_a_block():
    w = {"a": 0.5, "b": 0.3, "c": 0.13, "d": 0.07}
    done = dict.fromkeys(w, 0)
    for t, (s, k, slot) in enumerate(mixture.pfair(w, 500), 1):
        assert slot == t - 1 and k == done[s]
        done[s] += 1
        assert all(abs(done[x] - w[x] * t) < 1 for x in w)


def test_frames_keep_shares(spark):
    n = {"a": 500, "b": 300, "c": 130, "d": 70, "e": 3}
    rows = sorted((r["slot"], r["source"], r["block"]) for r in mixture.schedule(spark, n, 100).collect())
    assert [r[0] for r in rows] == list(range(1003)) and {(s, k) for _, s, k in rows} == {(s, k) for s, m in n.items() for k in range(m)}
    done = dict.fromkeys(n, 0)
    for t, (_, s, k) in enumerate(rows, 1):
        assert k == done[s]
        done[s] += 1
        assert all(abs(done[x] - m * t / 1003) < (2 if x != "a" else 1 + len(n)) for x, m in n.items())
    assert mixture.schedule(spark, {}).count() == 0


def test_contributions_respect_caps():
    g = mixture.contributions({"a": 100, "b": 10, "c": 50}, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.1}, {"a": 2, "b": 2, "c": 1, "d": 1})
    assert g["b"] == 20 and "d" not in g
    assert math.isclose(g["a"] / g["c"], 0.5 / 0.2) and math.isclose(sum(g.values()), 160)


def test_mixture_shares_and_copies(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["one", "two", "դեզ", "three"], k=rng.randint(5, 60))), rng.choice(["Big ", "big", "mid", " SMALL"] if i % 4 else ["big"])) for i in range(600)] + [(900, "x", None), (901, None, "big"), (902, "", "mid"), (903, "y", "unlisted")]
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2)], "source string, target_share double, max_repeats int")
    m = mixture.Mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), t)
    r = m.rows().toPandas()
    assert not r.duplicated(["doc_id", "copy"]).any() and (r.n_tokens > 0).all()
    assert all(r[r.source == s]["copy"].max() < c for s, c in (("big", 1), ("mid", 3), ("small", 2)))
    rep = m.report().toPandas().set_index("source")
    for s, g in m.gives.items():
        assert abs(rep.n_used[s] - g) <= 200
    assert mixture.Mixture(spark.createDataFrame([], "doc_id long, text string, source string"), t).report().count() == 3


def test_reading_counts_and_levels(spark):
    texts = {
        1: "== Head ==\nThe cat sat. It is big!\n* list item\n[[a]] + [[b]]",
        2: "# Նա մի տուն է։ Այս բառը։",
        3: "Phonological characterization necessitates internationalization; considerations notwithstanding: " * 5 + ".",
        4: "",
        5: None,
        6: "* only\n* a list",
        7: "word " * 5000,
    }
    d = spark.createDataFrame([(k, v, 9, 9) for k, v in texts.items()], "doc_id long, text string, grade int, n_words int").select("doc_id", "text")
    g = {r["doc_id"]: r for r in reading.graded(d).collect()}
    assert (g[1]["n_words"], g[1]["n_sentences"], g[1]["n_syllables"], g[1]["script"]) == (6, 2, 6, "latin")
    assert (g[2]["n_words"], g[2]["n_sentences"], g[2]["n_syllables"], g[2]["script"]) == (6, 2, 7, "armenian")
    assert g[4]["grade"] is None and g[5]["grade"] is None and g[6]["grade"] is None
    assert g[7]["n_sentences"] == 5000 // reading.LONGEST_SENTENCE
    assert g[3]["grade"] > g[1]["grade"]
    labels = spark.createDataFrame([(1, "basic"), (3, "advanced"), (3, "advanced"), (77, "basic"), (1, None)], "doc_id long, reading_level string")
    lv = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(d, labels, Scratch(spark)).collect()}
    assert lv[3] == "advanced" and lv[1] == "basic" and lv[4] == lv[5] == lv[6] == "none"
    assert reading.reading_levels(d.limit(0), labels.limit(0), Scratch(spark)).count() == 0


def test_held_out_accuracy_of_levels(spark):
    rng = random.Random(2)
    voc = {"basic": ["cat", "dog", "sun", "big"], "middle": ["teacher", "family", "water", "story"], "advanced": ["characterization", "internationalization", "phonological"]}
    rows, labels = [], []
    for i in range(150):
        lv = ("basic", "middle", "advanced")[i % 3]
        n = {"basic": 6, "middle": 12, "advanced": 24}[lv]
        rows.append((i, ". ".join(" ".join(rng.choices(voc[lv], k=n)) for _ in range(6))))
        labels.append((i, lv if rng.random() > 0.1 else "middle"))
    lv = reading.reading_levels(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels[:75], "doc_id long, reading_level string"), Scratch(spark)).collect()
    right = [r["reading_level"] == ("basic", "middle", "advanced")[r["doc_id"] % 3] for r in lv if r["doc_id"] >= 75]
    assert sum(right) / len(right) > 0.95
