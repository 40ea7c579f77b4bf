"""Vector codes against plain rounds of k-means, and the trees against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm import vector_codes as vc
from patchloom.session import local_table

VECTORS = "vec_id long, embedding array<double>, label string, code string, trees int"


def plain(rows, parts=4, entries=256, rounds=4):
    """(id, code, error) of whole-numbered rows in the order of ids, and the codebooks."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [np.array_split(np.array([int(v) for v in r[1]], object), parts) for r in rows]
    books = [[r[p] for r in x[:entries]] for p in range(parts)]

    def near(p, v):
        d = [int(((v - e) ** 2).sum()) for e in books[p]]
        return min(range(len(d)), key=lambda e: (d[e], e)), min(d)

    for _ in range(rounds):
        own = [[near(p, r[p])[0] for r in x] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [r[p] for r, o in zip(x, own[p]) if o == e]
                if mine:
                    books[p][e] = sum(mine[1:], mine[0]) // len(mine)
    found = []
    for r, v in zip(rows, x):
        at = [near(p, v[p]) for p in range(parts)]
        found.append((r[0], "".join(f"{e:02x}" for e, _ in at), min(sum(d for _, d in at), 2**63 - 1)))
    return sorted(found, key=repr), [[list(map(int, e)) for e in b] for b in books]


def check(spark, rows, **options):
    df = local_table(spark, [(i, [v / 1024 for v in x], "a", "x", 1) for i, x in rows], VECTORS)
    df = df.select("*", vc.quantise(F.col("embedding")).alias("x"))
    coded, books = vc.encode(df, **options)
    options.pop("block_rows", None)
    want, want_books = plain(rows, **options)
    assert sorted(((r.vec_id, r.code, r.error) for r in coded.collect()), key=repr) == want
    assert books == want_books


def test_codes_of_clusters_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (9, 8))
    x = np.concatenate([centres[rng.integers(0, 9, 250)] + rng.integers(-30, 30, (250, 8)), np.repeat(centres[:2], 60, 0)])
    x = np.concatenate([x, rng.integers(-2, 3, (60, 8)), np.zeros((5, 8), int)])
    ids = [int(i) for i in rng.permutation(len(x))]
    ids[:3] = [None, 7, 7]
    check(spark, [(i, v.tolist()) for i, v in zip(ids, x)], entries=16, block_rows=100)


def test_codes_of_few_rows_uneven_parts_and_large_numbers(spark):
    rng = np.random.default_rng(4)
    check(spark, [(3, [1, 2, 3, 4, 5])])
    check(spark, [(i, rng.integers(-5, 5, 7).tolist()) for i in range(40)], entries=5)
    check(spark, [(i, rng.integers(-5, 5, 2).tolist()) for i in range(10)], entries=5)  # parts without components
    large = [(i, (rng.integers(-(2**20), 2**20, 6) * 2**30).tolist()) for i in range(50)]
    check(spark, large, entries=6, block_rows=20)


def test_rows_that_do_not_fit(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2, 3, 4]), (2, None), (3, [1.0, None, 3, 4]), (4, [nan, 1, 1, 1]), (5, [-inf, 1, 1, 1]),
            (6, [1.0, 2, 3]), (7, []), (8, [1e300, -1e300, 0, 0.9999]), (None, [1.0, 2, 3, 4])]
    df = local_table(spark, [(i, x, None if i == 8 else "b", "x", 1) for i, x in rows], VECTORS)
    coded, books = vc.encode(df.select("*", vc.quantise(F.col("embedding")).alias("x")))
    got = {r.vec_id: (r.code, r.error) for r in vc.with_label_error(coded).collect()}
    assert got == {1: ("00000000", 0), 6: (None, None), 7: (None, None), 8: ("01010101", 0), None: ("00000000", 0)}
    assert books[0] == [[1024], [2**53], [1024]] and books[3] == [[4096], [1023], [4096]]
    empty, books = vc.encode(df.where("false").withColumn("x", vc.quantise(F.col("embedding"))))
    assert empty.count() == 0 and books == [[], [], [], []]


def test_label_errors_add_up(spark):
    rows = [(1, None, "00", 3), (2, None, "00", 4), (3, "a", "00", 2**63 - 1), (4, "a", "00", 9), (5, "b", None, None)]
    got = vc.with_label_error(local_table(spark, rows, "vec_id long, label string, code string, error long")).collect()
    assert {r.vec_id: r.label_error for r in got} == {1: 7, 2: 7, 3: 2**63 - 1, 4: 2**63 - 1, 5: None}


@pytest.mark.parametrize("spread", [1, 40, 3000])
def test_balls_cover_their_points_and_lists_keep_the_nearest(spread):
    rng = np.random.default_rng(spread)
    x = (rng.integers(-3000, 3000, (12, 6))[rng.integers(0, 12, 900)] + rng.integers(-spread, spread + 1, (900, 6))).astype(float)
    t = vc.Balls(x)
    assert sorted(t.order) == list(range(900)) and (t.first[t.root], t.last[t.root]) == (0, 900)
    for i in range(len(t.first)):
        own = x[t.order[t.first[i] : t.last[i]]]
        assert np.allclose(own.sum(0), t.total[i])
        assert np.sqrt(((own - t.centre[i]) ** 2).sum(1)).max() <= t.radius[i] * (1 + 1e-9)
    entries = np.concatenate([x[:20], x[5:8], rng.integers(-3000, 3000, (10, 6))]).astype(float)
    tree = (t.first, t.last, t.left, t.right, t.centre, t.radius, t.root)
    balls, by, rows, chosen, compared = vc.nearest(x, t.order, tree, entries)
    got = np.full(900, -1)
    for b, e in zip(balls, by):
        got[t.order[t.first[b] : t.last[b]]] = e
    got[rows] = chosen
    assert (got == vc.distances(x, entries).argmin(1)).all()
    counts, sums = vc.sums_of(x, t.order, tree, t.total, entries)
    assert (counts == np.bincount(got, minlength=len(entries))).all() and np.allclose(sums.sum(0), x.sum(0))
    if spread < 3000:  # clusters are owned whole; most distances are never computed
        assert len(balls) and compared < 0.2 * len(x) * len(entries)
