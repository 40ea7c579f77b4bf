"""Vector codes: product quantisation whose k-means runs on trees of balls.

Vectors are cut into parts, and every part position has a codebook. Assigning all
vectors' parts to the nearest entries, round after round, is done on metric trees that
are built once. A tree covers one part position of a block of vectors. It is grown
middle-out: anchors are chosen far from each other and take the points nearest to
them, each anchor's points become a tree of their own, and the anchors' balls are
merged pairwise up to the root. Every ball caches the count and sum of its points.

A round goes down all trees of a block with the list of entries that may still be the
nearest of some point in a ball. A child inherits its parent's list and shortens it: an
entry goes if the whole ball lies on another entry's side of the plane between them.
A ball left with one entry is wholly owned and hands over its cached sum and count;
only points in unowned leaves are compared one by one, in whole numbers.
"""

from __future__ import annotations

from contextlib import contextmanager
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchloom.llm.common import BATCH_SETTING
from patchloom.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Vectors of a block, points of a leaf at most, and blocks that are sent to Python at a time.
BLOCK_ROWS, LEAF, BLOCKS = 4096, 24, 8
#: Components beyond are cut to it; sums of fewer than 2 ** 73 of them fit a decimal.
MOST = 2.0**53
#: Relative slack of ball bounds, which are floating-point numbers.
SLACK = 1e-9


def quantise(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of every component as double; null where the vector takes no part.

    That is a null vector and one with a null or non-finite component.
    """
    fine = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.floor(F.greatest(F.least(scaled, F.lit(MOST)), F.lit(-MOST))).cast("double")

    return F.when(fine, F.transform(vector, whole))


def integers(x: np.ndarray) -> np.ndarray:
    """Python integers in the shape of ``x``, for sums and products that a double would round."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def distances(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers, rows of ``x`` x rows of ``e``; exact at any size."""
    largest = max(np.abs(x).max(initial=0), np.abs(e).max(initial=0))
    if 4 * largest * largest * max(x.shape[1], 1) < 2.0**53:
        return (x * x).sum(1)[:, None] - 2 * (x @ e.T) + (e * e).sum(1)
    rows = [((integers(row)[None] - integers(e)) ** 2).sum(1) for row in x]
    return np.array(rows, object).reshape(len(x), len(e))


class Balls:
    """A metric tree over the rows of ``x``; rows are reordered so that a ball is a stretch of ``order``.

    Arrays with a row per ball: first, last (stretch), left, right (children or -1),
    centre, radius, total (sum of the points; null where a double may round it).
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.stretches: list[np.ndarray] = []
        self.first, self.last, self.left, self.right = [], [], [], []
        self.placed = 0
        root = self._grow(np.arange(len(x)))
        self.order = np.concatenate(self.stretches) if self.stretches else np.zeros(0, np.int64)
        self._arrange(root)

    def _leaf(self, rows: np.ndarray) -> int:
        self.stretches.append(rows)
        self.placed += len(rows)
        return self._ball(self.placed - len(rows), self.placed, -1, -1)

    def _ball(self, first: int, last: int, left: int, right: int) -> int:
        for column, v in zip((self.first, self.last, self.left, self.right), (first, last, left, right)):
            column.append(v)
        return len(self.first) - 1

    def _grow(self, rows: np.ndarray) -> int:
        if len(rows) <= LEAF:
            return self._leaf(rows)
        owner, pivots = anchors(self.x[rows])
        if len(pivots) < 2:  # all points are equal
            return self._leaf(rows)
        merges = merge_order(self.x[rows[pivots]], np.bincount(owner, minlength=len(pivots)))
        return self._merge(rows, owner, merges)

    def _merge(self, rows: np.ndarray, owner: np.ndarray, tree) -> int:
        """Balls of a nested pair of anchors; depth first, so that each is one stretch."""
        if not isinstance(tree, tuple):
            return self._grow(rows[owner == tree])
        start = self.placed
        left = self._merge(rows, owner, tree[0])
        right = self._merge(rows, owner, tree[1])
        return self._ball(start, self.placed, left, right)

    def _arrange(self, root: int) -> None:
        self.root = root
        columns = self.first, self.last, self.left, self.right
        self.first, self.last, self.left, self.right = (np.array(c, np.int64) for c in columns)
        x = self.x[self.order]
        sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, 0)])
        if len(x) * np.abs(x).max(initial=0) < 2.0**53:
            self.total = sums[self.last] - sums[self.first]
        else:
            self.total = None
        size = np.maximum(self.last - self.first, 1)[:, None]
        self.centre = (sums[self.last] - sums[self.first]) / size
        self.radius = np.array([
            np.sqrt(((x[a:b] - c) ** 2).sum(1).max(initial=0)) for a, b, c in zip(self.first, self.last, self.centre)
        ])


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """About root of n anchors far from each other: the anchor of every row, and the anchors' rows.

    A new anchor takes points only from anchors that may have some nearer to it: a point
    nearer to its own than half the distance of the two anchors stays unlooked at.
    """
    owner, pivots = np.zeros(len(x), np.int64), [0]
    near = np.sqrt(((x - x[0]) ** 2).sum(1))
    for _ in range(int(np.sqrt(len(x))) - 1):
        far = int(near.argmax())
        if near[far] == 0:
            break
        apart = np.sqrt(((x[pivots] - x[far]) ** 2).sum(1))
        some = np.flatnonzero(near > apart[owner] / 2)
        d = np.sqrt(((x[some] - x[far]) ** 2).sum(1))
        taken = some[d < near[some]]
        near[taken] = d[d < near[some]]
        owner[taken] = len(pivots)
        pivots.append(far)
    return owner, np.array(pivots)


def merge_order(centres: np.ndarray, sizes: np.ndarray):
    """Nested pairs of all anchors' numbers, nearest balls merged first."""
    trees, c, n = list(range(len(centres))), centres.astype(np.float64), sizes.astype(np.float64)
    apart = ((c[:, None] - c[None]) ** 2).sum(2)
    np.fill_diagonal(apart, np.inf)
    alive = len(trees)
    while alive > 1:
        i, j = sorted(divmod(int(apart.argmin()), len(trees)))
        trees[i], trees[j] = (trees[i], trees[j]), None
        c[i] = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j])
        n[i] += n[j]
        apart[j] = apart[:, j] = np.inf
        gone = np.array([t is None for t in trees])
        apart[i] = apart[:, i] = np.where(gone, np.inf, ((c - c[i]) ** 2).sum(1))
        apart[i, i] = np.inf
        alive -= 1
    return trees[0]


def owned(tree, entries: np.ndarray):
    """Balls wholly owned by one entry, and leaves with several that may be nearest.

    ``tree`` has first, last, left, right, centre, radius, root. Gives (balls, their
    entries, leaves, rows x entries of what is left of their lists). Entries equal to an
    earlier one are in no list, as ties go to the lower index.
    """
    first, last, left, right, centre, radius, root = tree
    start = np.zeros(len(entries), bool)
    start[np.unique(entries, axis=0, return_index=True)[1]] = True
    apart = np.sqrt(np.maximum(((entries[:, None] - entries[None]) ** 2).sum(2), 0))
    balls, by, leaves, lists = [], [], [], []
    at, alive = np.array([root]), start[None]
    while len(at):
        d = ((centre[at] ** 2).sum(1)[:, None] - 2 * centre[at] @ entries.T + (entries**2).sum(1)).clip(0)
        best = np.where(alive, d, np.inf).argmin(1)
        least = d[np.arange(len(at)), best][:, None]
        size = (centre[at] ** 2).sum(1)[:, None] + (entries**2).sum(1)
        beyond = 2 * radius[at][:, None] * apart[best] * (1 + SLACK) + SLACK * (1 + size)
        alive = alive & (d - least <= beyond)
        alone = alive.sum(1) == 1
        balls.append(at[alone])
        by.append(alive[alone].argmax(1))
        ends = ~alone & (left[at] < 0)
        leaves.append(at[ends])
        lists.append(alive[ends])
        go = ~alone & ~ends
        at, alive = np.concatenate([left[at[go]], right[at[go]]]), np.concatenate([alive[go]] * 2)
    return np.concatenate(balls), np.concatenate(by), np.concatenate(leaves), np.concatenate(lists)


def nearest(x: np.ndarray, order: np.ndarray, tree, entries: np.ndarray):
    """(owned balls, their entries, rows compared one by one, their entries, comparisons)."""
    balls, by, leaves, lists = owned(tree, entries)
    first, last = tree[0], tree[1]
    rows, chosen, compared = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i in range(0, len(leaves), 256):
        some = leaves[i : i + 256]
        sizes = last[some] - first[some]
        own = np.repeat(np.arange(len(some)), sizes)
        r = order[np.repeat(first[some], sizes) + np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        may = lists[i : i + 256][own]
        used = np.flatnonzero(may.any(0))
        d = distances(x[r], entries[used])
        d = np.where(may[:, used], d, np.inf if d.dtype != object else 2**200)
        rows.append(r)
        chosen.append(used[d.argmin(1)])
        compared += int(may.sum())
    return balls, by, np.concatenate(rows), np.concatenate(chosen), compared


def sums_of(x: np.ndarray, order: np.ndarray, tree, total, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the points nearest to every entry; whole balls come from the cache."""
    balls, by, rows, chosen, _ = nearest(x, order, tree, entries)
    sizes = (tree[1] - tree[0])[balls]
    if total is None:
        rows = np.concatenate([rows, *(order[tree[0][b] : tree[1][b]] for b in balls)])
        chosen = np.concatenate([chosen, np.repeat(by, sizes)])
        counts, sums = np.bincount(chosen, minlength=len(entries)), np.zeros(entries.shape, object)
        np.add.at(sums, chosen, integers(x[rows]))
        return counts, sums
    counts = np.bincount(by, sizes, len(entries)).astype(np.int64) + np.bincount(chosen, minlength=len(entries))
    sums = np.zeros(entries.shape)
    np.add.at(sums, by, total[balls])
    np.add.at(sums, chosen, x[rows])
    return counts, sums


FIELDS = ("first", "last", "left", "right", "centre", "radius")
TREE = pa.struct([
    ("points", pa.binary()), ("wide", pa.int32()), ("order", pa.binary()), ("root", pa.int32()),
    *((f, pa.binary()) for f in FIELDS), ("total", pa.binary()),
])
TREES = (
    "ids array<long>, labels array<string>, trees array<struct<points:binary,wide:int,order:binary,root:int,"
    + ",".join(f"{f}:binary" for f in FIELDS)
    + ",total:binary>>"
)


@contextmanager
def _batches(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for what is written inside."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def _trees(valid: DataFrame, parts: int, block_rows: int) -> DataFrame:
    """A row per block: its ids, its labels, and for every part position the points and their tree."""

    def stored(x: np.ndarray) -> dict:
        tree = Balls(x)
        arrays = {f: getattr(tree, f).tobytes() for f in FIELDS}
        total = None if tree.total is None else tree.total.tobytes()
        return {"points": x.tobytes(), "wide": x.shape[1], "order": tree.order.tobytes(), "root": tree.root, "total": total} | arrays

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                block = batch.slice(at, block_rows)
                x = np.array(block.column(2).flatten()).reshape(block.num_rows, -1)
                made = [stored(np.ascontiguousarray(piece)) for piece in np.array_split(x, parts, axis=1)]
                ids, labels = (block.column(i).to_pylist() for i in range(2))
                columns = [([ids], pa.int64()), ([labels], pa.string()), ([made], TREE)]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(t)) for v, t in columns], ["ids", "labels", "trees"])

    return valid.select("vec_id", "label", "x").mapInArrow(run, TREES)


def _read(t: dict):
    """points, order, tree, total of a stored tree."""

    def array(name: str, kind=np.int64, shape=-1):
        return np.frombuffer(t[name], kind).reshape(shape)

    ints = [array(f) for f in FIELDS[:4]]
    shape = len(ints[0]), t["wide"]
    tree = (*ints, array("centre", np.float64, shape), array("radius", np.float64), t["root"])
    points = array("points", np.float64).reshape(len(array("order")), t["wide"])
    return points, array("order"), tree, None if t["total"] is None else array("total", np.float64, shape)


def _moved(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: floors of the means of what every entry owns."""

    def run(batches):
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for made in batch.column(0).to_pylist():
                for i, (t, book) in enumerate(zip(made, books)):
                    n, s = sums_of(*_read(t), book)
                    counts[i] += n
                    sums[i] += s if s.dtype == object else integers(s)
        found = [(p, e, [n, *s]) for p in range(len(books)) for e, (n, s) in enumerate(zip(counts[p].tolist(), sums[p])) if n]
        part, entry, rows = zip(*found) if found else ((),) * 3
        kind = pa.list_(pa.decimal128(38, 0))
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array([[*map(Decimal, r)] for r in rows], kind)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "s"])

    wide = max(b.shape[1] for b in books) + 1
    sums = trees.select("trees").mapInArrow(run, "part int, entry int, s array<decimal(38,0)>")
    sums = sums.groupBy("part", "entry").agg(*(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(wide)))
    moved = [b.copy() for b in books]
    for r in sums.collect():  # at most parts x entries rows
        book = moved[r["part"]]
        book[r["entry"]] = [int(r[f"s{i}"]) // int(r["s0"]) for i in range(1, book.shape[1] + 1)]
    return moved


def _coded(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error, and the distances computed in leaves of the block, on its first row."""

    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                n, work = len(block["ids"]), 0
                codes, error = [], integers(np.zeros(n))
                for t, book in zip(block["trees"], books):
                    x, order, tree, _ = _read(t)
                    balls, by, rows, chosen, compared = nearest(x, order, tree, book)
                    code = np.zeros(n, np.int64)
                    for b, e in zip(balls, by):
                        code[order[tree[0][b] : tree[1][b]]] = e
                    code[rows] = chosen
                    codes.append(code)
                    work += compared
                    apart = x - book[code]
                    fits = np.abs(apart).max(initial=0) ** 2 * max(x.shape[1], 1) < 2.0**53
                    error += integers((apart**2).sum(1)) if fits else ((integers(x) - integers(book[code])) ** 2).sum(1)
                text = ["".join(f"{c[i]:02x}" for c in codes) for i in range(n)]
                columns = [
                    pa.array(block["ids"], pa.int64()), pa.array(block["labels"], pa.string()), pa.array(text),
                    pa.array([min(e, 2**63 - 1) for e in error], pa.int64()), pa.array([work] + [0] * (n - 1), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "work"])

    return trees.mapInArrow(run, CODED)


CODED = "vec_id long, label string, code string, error long, work long"


def encode(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, list[list[list[int]]]]:
    """Codes of all vectors, and the codebooks (by part, entry, position).

    ``vectors`` has vec_id, label and ``x``, quantised components; other columns are
    ignored. Rows whose ``x`` is null are dropped. Result: vec_id, label (as text), code
    (two hex digits a part), error (squared distances summed over the parts, at most the
    largest long), work (distances computed for a block, on one of its rows).

    Every codebook starts as that part of the vectors with the ``entries`` smallest ids
    (rows with one id by their components, null ids last; of fewer rows, all). In each
    of ``rounds`` rounds all parts go to their nearest entries, ties to the lower index,
    and entries become the floors of their means; unused ones stay. Lengths that
    ``parts`` does not divide make the first parts longer by one. All vectors have the
    length of the one with the smallest id; others keep a row with null code and error,
    as do vectors without components. Components beyond 2 ** 53 are cut to that.

    Trees are built once and written; a round sends out the codebooks (parts x entries
    rows, whatever the input) and gets back one row of sums for each entry.
    """
    rows = vectors.where("x is not null").select("vec_id", F.col("label").cast("string").alias("label"), "x")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    dim = len(start[0]["x"]) if start else 0
    fits = F.size("x") == max(dim, 1)
    first = rows.where(fits).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"))]
    other = rows.where(~fits).select("vec_id", "label", *none, F.lit(0).cast("long").alias("work"))
    if not first:
        return other, [[] for _ in range(parts)]
    books = [b.copy() for b in np.array_split(np.array([r["x"] for r in first], np.float64), parts, axis=1)]
    with _batches(rows.sparkSession, block_rows):
        trees = written(_trees(rows.where(fits), parts, block_rows))
    with _batches(rows.sparkSession, BLOCKS):
        for _ in range(rounds):
            books = _moved(trees, books)
        coded = written(_coded(trees, books))
    return coded.union(other), [[[int(v) for v in e] for e in b] for b in books]


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows with its label, nulls together; at most the largest long."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = coded.groupBy("label").agg(F.when(total > most, most).otherwise(total).cast("long").alias("label_error"))
    sums = sums.withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
