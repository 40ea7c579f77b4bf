"""Operators that compare rows with each other, against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from patchloom.llm import common, near_texts, near_vectors, queries, repeats, topk
from patchloom.llm.common import components
from patchloom.session import local_table, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return local_table(spark, [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)], DOCS)


def roots(nodes, links):
    up = {v: v for v in nodes}

    def find(v):
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


def test_components_of_chains_stars_and_rings(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)]
    links += [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(7, 7)]
    links += [(int(a) + 5000, int(b) + 5000) for a, b in rng.integers(0, 400, (250, 2))]
    rng.shuffle(links)
    edges = local_table(spark, [(int(a), int(b)) for a, b in links] + [(None, 3)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    want = roots({v for e in links for v in e}, links)
    alone = {a for a, b in links if a == b} - {v for a, b in links if a != b for v in (a, b)}
    assert got == {k: int(v) for k, v in want.items() if k not in alone}
    assert components(local_table(spark, [], "u long, v long")).count() == 0


def test_steps_without_work_are_left_out(spark, monkeypatch):
    calls = []

    def counted(df):
        calls.append(1)
        return written(df)

    monkeypatch.setattr(common, "written", counted)
    monkeypatch.setattr(near_texts, "written", counted)
    edges = local_table(spark, [(1, i) for i in range(2, 40)], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 1) for i in range(1, 40)}
    assert len(calls) == 1  # these are stars already, so no round is run
    calls.clear()
    got = {tuple(r) for r in near_texts.near_texts(docs_of(spark, [f"a{i} b{i} c{i}" for i in range(9)]), 2).collect()}
    assert got == {(i, 2, i, True) for i in range(9)}
    assert len(calls) == 3  # no bucket holds two documents
    calls.clear()
    got = near_texts.near_texts(docs_of(spark, ["a b c d e f g h i j", "a b c d e f g h i j k", "x y"]), 2)
    assert {tuple(r) for r in got.collect()} == {(0, 9, 0, True), (1, 10, 0, False), (2, 1, 2, True)}
    assert len(calls) <= 10  # one star links all, nothing is undecided


# -- documents ----------------------------------------------------------------------------------


def plain_sets(texts, size):
    out = []
    for t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def plain_near(texts, size, percent=80):
    sets = plain_sets(texts, size)
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                links.append((j, i))
    comp = roots(range(len(texts)), links)
    return {(i, len(sets[i]), comp[i], comp[i] == i) for i in range(len(texts))}


def mutated(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.integers(10**9)}" for w in words)


@pytest.fixture(scope="module")
def copies():
    """Exact and near copies in groups of all kinds, one of them large and with links of its centre only."""
    rng = np.random.default_rng(11)
    texts = [None, "", " \n ", "One", "one", "ONE two", "two ONE", "é É", "é É"]
    for group in range(12):
        words = [f"g{group}w{i}" for i in range(rng.integers(20, 120))]
        texts += [mutated(rng, words, s) for s in rng.uniform(0, 0.12, 6)]
    words = [f"hot{i}" for i in range(100)]
    texts += [mutated(rng, words, s) for s in rng.uniform(0, 0.11, 150)] + [" ".join(words)] * 30
    texts += [" ".join(f"u{rng.integers(40)}" for _ in range(60)) for _ in range(60)]
    texts.append(" ".join(f"long{i}" for i in range(40_000)))
    return [texts[i] for i in rng.permutation(len(texts))]


@pytest.mark.parametrize("size", [2, 5])
def test_near_texts_equals_brute_force(spark, copies, size):
    got = {tuple(r) for r in near_texts.near_texts(docs_of(spark, copies), size).collect()}
    assert got == plain_near(copies, size)


def test_near_texts_in_small_blocks(spark, copies, monkeypatch):
    monkeypatch.setattr(near_texts, "BLOCK_ROWS", 7)
    monkeypatch.setattr(near_texts, "STAR_ELEMENTS", 500)
    got = {tuple(r) for r in near_texts.near_texts(docs_of(spark, copies), 2).collect()}
    assert got == plain_near(copies, 2)


def test_sift_loses_no_row_and_sends_few_to_the_join(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("if(id < 9, null, id * id - 7) as key", "cast(id as string) as text", "1 as _word")
    ids = spark.range(0, 20_000, 50).selectExpr("id * id - 7 as key")
    held = {i * i - 7 for i in range(50, 20_000, 50)}
    for words, most in ((common.SIFT_WORDS, 410), (1, 20_000)):
        monkeypatch.setattr(common, "SIFT_WORDS", words)
        maybe, others = common.sift(rows, ids, "key")
        assert maybe.columns == others.columns == rows.columns
        first, second = [r.key for r in maybe.collect()], [r.key for r in others.collect()]
        assert len(first) + len(second) == 20_000 and len(first) <= most
        assert held <= set(first) and not held & set(second)
    maybe, others = common.sift(rows, ids.limit(0), "key")
    assert maybe.count() == 0 and others.count() == 20_000


def test_near_texts_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h"
    rows = [(5, text, None, None, None), (5, text, None, None, None), (3, text, None, None, None), (None, text, None, None, None)]
    docs = local_table(spark, rows, DOCS).selectExpr("*", "1 as component_id", "'x' as h")
    got = [tuple(r) for r in near_texts.near_texts(docs, 2).collect()]
    assert sorted(got, key=repr) == sorted([(5, 7, 3, False)] * 2 + [(3, 7, 3, True), (None, 7, None, False)], key=repr)
    assert [r.doc_id for r in near_texts.dedup(docs, 2).collect()] == [3]
    assert near_texts.near_texts(docs_of(spark, []), 2).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = np.unique(x[:1000]), np.unique(x[500:])
    same = np.mean(near_texts.signature(a) == near_texts.signature(b))
    assert abs(same - 1 / 3) < 0.12


# -- vectors ------------------------------------------------------------------------------------


def plain_vectors(rows, least):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for n, (i, a) in enumerate(good):
        for j, b in good[:n]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links.append((j, i))
    comp, n = roots([i for i, _ in rows], links), Counter(v for e in links for v in e)
    return {(i, n[i], comp[i], comp[i] == i) for i, _ in rows}


@pytest.mark.parametrize("cell_rows, block_rows", [(10**6, 10**6), (8, 5), (30, 16)])
def test_near_vectors_equals_brute_force(spark, monkeypatch, cell_rows, block_rows):
    monkeypatch.setattr(near_vectors, "MOST_VISITS", 1e9)
    rng = np.random.default_rng(4)
    x = [v for c in rng.normal(size=(25, 6)) for v in c + rng.normal(size=(8, 6)) * rng.choice([0.02, 0.15, 0.3])]
    x += [x[0] * 3, x[0], x[0]] + [rng.normal(size=4) for _ in range(30)]
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(1000), x)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000 + i, v) for i, v in enumerate([None, [], [0.0] * 6, [1.0, None], [nan] * 6, [inf] * 6, [1e-200] * 6, [1e200] * 6])]
    vectors = local_table(spark, rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as kept")
    got = {tuple(r) for r in near_vectors.near_vectors(vectors, 0.95, cell_rows, block_rows).collect()}
    # Huge and tiny vectors are compared by direction, which plain squares cannot.
    want = plain_vectors([(i, [c / max(map(abs, v)) for c in v] if i in (2006, 2007) else v) for i, v in rows], 0.95)
    assert got == want


def test_near_vectors_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "MOST_VISITS", 1e9)
    monkeypatch.setattr(near_vectors, "TILE", 7)
    rng = np.random.default_rng(6)
    x = [v for c in rng.normal(size=(12, 5)) for v in c + rng.normal(size=(8, 5)) * rng.choice([0.05, 0.3])]
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(1000), x)]
    vectors = local_table(spark, rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in near_vectors.near_vectors(vectors, 0.95, 20).collect()}
    assert got == plain_vectors(rows, 0.95)


def test_blocks_of_vectors_grow_with_the_table_to_a_bound():
    for dim in (1, 64, 1536):
        for n in (1, 5_000, 50_000, 250_000, 10**9):
            rows = near_vectors.rows_of_block(n, dim)
            assert rows * dim <= max(near_vectors.BLOCK_VALUES, dim)
            assert n <= 8 * rows or rows == near_vectors.BLOCK_VALUES // dim


def test_links_that_single_precision_cannot_tell():
    rng = np.random.default_rng(7)
    a = near_vectors.unit(rng.normal(size=(300, 64)), 300)
    b = near_vectors.unit(rng.normal(size=(300, 64)), 300)
    b = near_vectors.unit(b - (a * b).sum(1, keepdims=True) * a, 300)
    cos = 0.95 + rng.choice([-1, 1], 300) * 10.0 ** -rng.integers(3, 14, 300)
    b = cos[:, None] * a + np.sqrt(1 - cos**2)[:, None] * b
    exact = lambda i, j: (a[i] * b[j]).sum(1)
    rows, columns, ok = near_vectors.compare(a.astype(np.float32), b.astype(np.float32), 0.95, False, exact)
    got = np.zeros((300, 300), bool)
    got[np.ix_(rows, columns)] = ok
    assert (got == (a @ b.T >= 0.95)).all() and 0 < got.sum() < 300
    rows, columns, ok = near_vectors.compare(a.astype(np.float32), a.astype(np.float32), 0.95, True, exact)
    assert ok.size == 0


def test_near_vectors_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])]
    got = [tuple(r) for r in near_vectors.near_vectors(local_table(spark, rows, schema)).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, 1, True)] * 2 + [(None, 0, None, False)], key=repr)
    assert near_vectors.near_vectors(local_table(spark, [], schema)).count() == 0


def plain_top(rows, k, ask):
    out = set()
    for q, a in rows:
        if a is not None and ask(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in rows if c != q and b is not None and len(a) == len(b))
            out |= {(q, r + 1, c, int(-s)) for r, (s, c) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("candidates, asked", [(10**6, 10**6), (40, 7)])
def test_top_k_equals_brute_force(spark, candidates, asked):
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (300, 20)) * rng.choice([1, 1, 8], (300, 1))  # many ties
    rows = [(i * 5, [float(c) for c in v]) for i, v in enumerate(x)] + [(1, None), (10_001, [1.0] * 3), (10_020, [2.0] * 3)]
    vectors = local_table(spark, rows, "vec_id long, x array<double>")
    got = {tuple(r) for r in topk.top_k(vectors, vectors.vec_id % 20 == 0, 7, candidates, asked).collect()}
    assert got == plain_top(rows, 7, lambda i: i % 20 == 0)


def test_top_k_large_components_and_odd_rows(spark):
    big = [(0, [2.0**40, 3.0]), (1, [2.0**20 + 1, 1.0]), (2, [2.0**20, 7.0]), (3, [2.0**62, 0.0])]
    vectors = local_table(spark, big, "vec_id long, x array<double>")
    got = [tuple(r) for r in topk.top_k(vectors, vectors.vec_id == 0, 3).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 2**63 - 1), (0, 2, 1, 2**60 + 2**40 + 3), (0, 3, 2, 2**60 + 21)]
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.01]), (20, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]), (100, [])]
    raw = local_table(spark, rows, "vec_id long, embedding array<float>")
    fine = {r.vec_id: r.x for r in raw.select("vec_id", topk.quantise(raw.embedding).alias("x")).collect()}
    assert fine == {0: [32.0, -1.0], 20: None, 40: None, 60: None, 80: None, 100: []}
    assert topk.top_k(vectors.where("vec_id < 0"), vectors.vec_id == 0, 3).count() == 0


def test_bounds_hold_and_sharpen():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(40, 37)), rng.normal(size=(50, 37))
    bounds = [topk.segments(a, n) @ topk.segments(b, n).T for n in (*topk.LEVELS, 37)]
    for wide, tight in zip(bounds, bounds[1:] + [a @ b.T]):
        assert (wide >= tight - 1e-9).all() or wide.mean() > tight.mean()
        assert (wide >= a @ b.T - 1e-9).all()


# -- repeated passages --------------------------------------------------------------------------


def plain_repeats(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("size, hot, shard", [(35, 2000, 200_000), (35, 3, 300), (5, 2, 50), (12, 4, 100)])
def test_repeats_equal_brute_force(spark, monkeypatch, size, hot, shard):
    monkeypatch.setattr(repeats, "HOT_REGIONS", hot)
    monkeypatch.setattr(repeats, "SHARD_WORDS", shard)
    rng = np.random.default_rng(size + hot)
    passage = [f"p{i}" for i in range(60)]
    few = ["a", "b", "c"]
    texts = [None, "", " ", "a " * 200, "one two"]
    for _ in range(60):
        parts = [[f"u{rng.integers(10**9)}" for _ in range(rng.integers(0, 50))] for _ in range(3)]
        low = int(rng.integers(0, 30))
        texts.append(" ".join(parts[0] + passage[low : int(rng.integers(low, 61))] + parts[1] + list(rng.choice(few, 25)) + parts[2]))
    texts += [texts[10]] * 4 + [texts[11] + "\n" + texts[11]]
    docs = docs_of(spark, texts).selectExpr("*", "1 as kept")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(docs, size).collect()}
    assert got == dict(enumerate(plain_repeats(texts, size)))


def test_repeats_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = local_table(spark, [(1, text, None, None, 0), (1, text, None, None, 0), (None, "x", None, None, 0)], DOCS)
    got = sorted((r.doc_id or 0, r.n_removed) for r in repeats.remove_repeats(docs, 35).collect())
    assert got == [(0, 0), (1, 40), (1, 40)]
    assert repeats.remove_repeats(docs_of(spark, []), 35).count() == 0


def test_automaton_counts_every_substring():
    rng = np.random.default_rng(9)
    added = [(rng.integers(0, 3, rng.integers(1, 25)).tolist(), int(rng.integers(1, 4))) for _ in range(12)]
    automaton = repeats.SuffixAutomaton()
    for words, weight in added:
        automaton.add(words, weight)
    automaton.count()
    for size in (1, 2, 4, 7):
        seen = defaultdict(int)
        for words, weight in added:
            for i in range(len(words) - size + 1):
                seen[tuple(words[i : i + size])] += weight
        probe = rng.integers(0, 4, 200).tolist()
        want = [seen[tuple(probe[max(0, i - size + 1) : i + 1])] if i >= size - 1 else 0 for i in range(len(probe))]
        assert automaton.matches(probe, size) == want


def test_all_queries_of_this_package_are_registered():
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 14))
