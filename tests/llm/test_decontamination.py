"""Winnowing against every window compared with every window."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm import decontaminate
from patchloom.session import local_table

DOCS = "doc_id long, text string, key1 long, row string, n_words int, words string, item string"
ITEMS = "item_id long, text string, length int, content string"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(len(v), window)
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    names.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(names), bool(hit)))
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    df = local_table(spark, [(*d, 1, "x", 2, "y", "z") for d in docs], DOCS)
    bench = local_table(spark, [(*i, 1, "x") for i in items], ITEMS)
    rows = decontaminate.contamination(df, bench, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows), key=repr)


def test_windows_of_few_words_and_many_lengths(spark):
    rng = np.random.default_rng(8)
    some = np.array("a B c1 é É ß 0 zz the THE 中".split())
    text = lambda n: " ".join(rng.choice(some, n))
    items = [(i, text(n)) for i, n in enumerate([1, 3, 9, 10, 11, 25, 60])]
    items += [(None, text(12)), (3, text(10)), (100, None), (101, " .,"), (102, "x " * 40), (2**40, "x " * 9 + "y")]
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 60, 60))]
    docs += [(100 + i, f"{text(4)}, {t.upper() if t else ''}! {text(3)}") for i, (_, t) in enumerate(items)]
    docs += [(None, items[5][1]), (5, items[5][1]), (5, None), (6, ""), (7, "x " * 3000), (8, docs[3][1]), (8, docs[3][1])]
    long = " ".join(f"w{i}" for i in range(20_000))
    docs += [(9, f"{long} {items[6][1]} {long}")]
    for kinds in (items, items[3:]):
        assert found(spark, docs, kinds) == plain(docs, kinds)


def test_odd_tables(spark):
    assert found(spark, [], [(1, "a b c")]) == []
    assert found(spark, [(1, "a b"), (None, None)], []) == plain([(1, "a b"), (None, None)], [])
    assert found(spark, [(1, "a b")], [(1, None), (2, "?!")]) == [(1, 2, 0, [], False)]
    docs, items = [(1, "a b c d e f"), (2, "a b c")], [(1, "a b c d e f")]
    assert found(spark, docs, items, window=3) == plain(docs, items, 3)


def test_kept_runs_of_shared_spans_are_shared(spark):
    """The guarantee, and that about two in w + 1 runs are kept."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        span = " ".join(map(str, rng.integers(0, 50, 10)))
        rows += [(i, f"{' '.join(map(str, rng.integers(0, 50, rng.integers(0, 30))))} {span} {k}") for k in "xy"]
    df = local_table(spark, rows, "i int, text string").withColumn("w", decontaminate.words_of(F.col("text")))
    runs = df.select("i", F.transform(decontaminate.kept_runs(F.col("w"), 10), decontaminate.run_hash).alias("h")).collect()
    each = {}
    for r in runs:
        each.setdefault(r.i, []).append(set(r.h))
    assert all(a & b for a, b in each.values())
    text = " ".join(map(str, rng.integers(0, 10**6, 20_000)))
    kept = local_table(spark, [(text,)], "text string").select(
        F.size(decontaminate.kept_runs(decontaminate.words_of(F.col("text")), 10)).alias("n")
    ).first()["n"]
    assert 0.2 * 20_000 < kept < 0.3 * 20_000


@pytest.mark.parametrize("text", ["ÀB c", "İI ſs KK", "ΑΣ ΑΣ.", "Ab-cD_e9\x7fz\x00y"])
def test_words_lower_a_to_z_only(spark, text):
    got = local_table(spark, [(text,)], "t string").select(decontaminate.words_of(F.col("t")).alias("w")).first()["w"]
    assert got == words(text)


def test_small_alphabets(spark):
    rng = np.random.default_rng(6)
    text = lambda: " ".join(rng.choice(["a", "b"], rng.integers(0, 15)))
    docs, items = [(i, text()) for i in range(150)], [(i, text()) for i in range(6)]
    items = [x for x in items if len(words(x[1])) > 3]
    assert found(spark, docs, items, window=4) == plain(docs, items, 4)
