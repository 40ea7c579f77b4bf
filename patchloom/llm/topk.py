"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments; a segment keeps its mean and deviation. With the
squared norms these give a lower bound of the distance of two vectors, and so an
upper bound of their inner product,

    sum over segments of  length * (mean * mean' + deviation * deviation'),

which gets sharper with shorter segments. Candidates that the coarse bound puts
below a query's k-th best score are dropped, survivors meet the next finer
bound, and only what is left is scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.session import written

#: Numbers of segments, coarse to fine.
LEVELS = (1, 4, 16)
#: Rows of a block of candidates and of queries; they bound what one task holds.
CANDIDATES, QUERIES = 8192, 1024
#: Relative slack of bounds, which are floating-point numbers; scores are integers.
SLACK = 1e-9
#: Queries of a block that are bounded at a time, and the share of survivors below which they are scored one by one.
STEP, SPARSE = 128, 0.02


def quantise(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component as double, or null where no vector takes part.

    Null vectors and vectors with a null or non-finite component do not.
    """
    fine = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def segments(x: np.ndarray, count: int) -> np.ndarray:
    """Means and deviations of ``count`` segments, each times the root of its length: rows x 2 count."""
    out = []
    for part in np.array_split(x, min(count, max(x.shape[1], 1)), axis=1):
        root = np.sqrt(part.shape[1])
        out += [part.mean(1) * root, part.std(1) * root] if part.shape[1] else []
    return np.stack(out, 1) if out else np.zeros((len(x), 1))


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, rows of ``q`` x rows of ``c``; in Python integers where a double may round."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1) < 2.0**53:
        return (q @ c.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in c]
    out = [[sum(int(a) * b for a, b in zip(row, other)) for other in whole] for row in q]
    return np.clip(np.array(out, object).reshape(len(q), len(c)), -(2**63), 2**63 - 1).astype(np.int64)


def survivors(q: np.ndarray, c: np.ndarray, stats, at: slice, alive: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Narrows ``alive`` (queries x candidates) from the coarsest bound to the finest."""
    floor = least.copy()
    for a, b in stats:
        bound = a[at] @ b.T
        bound += np.abs(bound) * SLACK + SLACK
        if np.isinf(floor).any() and alive.shape[1] > k:  # the exact scores of the k most promising give a floor
            first = np.argpartition(np.where(alive, -bound, np.inf), k - 1, axis=1)[:, :k]
            score = np.einsum("qd,qkd->qk", q, c[first])
            score[~np.take_along_axis(alive, first, 1)] = -np.inf
            floor = np.maximum(floor, score.min(1))
        alive = alive & (bound >= floor[:, None])
    return alive


def search_block(
    qid: np.ndarray, q: np.ndarray, least: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of a block for each query, ties to the smaller id.

    ``least`` has a score that k other candidates are known to reach, or minus
    infinity. Candidates below it, or below k others of this block, are left out.
    """
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    stats = [(segments(q, n), segments(c, n)) for n in LEVELS]
    fits = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(c.shape[1], 1) < 2.0**53
    found = [(np.zeros(0, np.int64),) * 3]
    for i in range(0, len(q) if len(c) else 0, STEP):
        at = slice(i, i + STEP)
        alive = qid[at, None] != cid
        if fits:
            alive = survivors(q[at], c, stats, at, alive, least[at], k)
        if alive.mean() < SPARSE:
            row, col = np.nonzero(alive)
            score = np.concatenate([exact(q[i + r][None], c[col[row == r]])[0] for r in np.unique(row)] or [col])
        else:
            table = exact(q[at], c)
            if len(c) > k:  # only what reaches the k-th best of its row can be among the k best
                ranked = np.where(alive, table, np.iinfo(np.int64).min)
                alive &= table >= np.partition(ranked, len(c) - k, axis=1)[:, len(c) - k, None]
            row, col = np.nonzero(alive)
            score = table[row, col]
        best = np.lexsort((cid[col], -score, row))
        place = np.arange(len(best)) - np.searchsorted(row[best], row[best])
        best = best[(place < k) & (score[best] >= least[at][row[best]])]
        found.append((qid[at][row[best]], cid[col[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Block results of rows (query block, candidate block, is_query, id, x, least)."""

    def run(key, t):
        ask = t.column("is_query").to_numpy().astype(bool)
        ids, x = t.column("id").to_numpy(), _matrix(t.column("x"), t.num_rows)
        least = t.column("least").to_numpy()
        out = search_block(ids[ask], x[ask], least[ask], ids[~ask], x[~ask], k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out)))

    schema = "query_id long, vec_id long, score long"
    return pairs.groupBy("dim", "query_block", "block").applyInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, queries: Column, k: int = 20, candidates: int = CANDIDATES, asked: int = QUERIES
) -> DataFrame:
    """The ``k`` largest integer inner products of each query with every other row.

    ``vectors`` has vec_id (distinct, not null) and ``x``, quantised components;
    ``queries`` says which rows ask. Returns query_id, rank (from 1), vec_id,
    score; fewer than ``k`` rows where there are fewer candidates, ties to the
    smaller vec_id. Rows whose ``x`` is null take no part; vectors meet only
    vectors of the same length; scores beyond a long are its limits.

    Rows are dealt to blocks of about ``candidates`` rows by a hash of the id, so
    equal vectors spread evenly; each block of queries meets every block of
    candidates in a task of its own. A first round on one block gives every
    query a score that its k-th best reaches at least, so that the second one
    sends on hardly more rows than it has to.
    """
    rows = vectors.where("x is not null and vec_id is not null")
    rows = rows.select("vec_id", "x", F.size("x").alias("dim"), queries.alias("asks"))
    rows = rows.dropDuplicates(["vec_id"])
    count = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("m")).collect()
    most, most_asked = max((r["n"] for r in count), default=0), max((r["m"] for r in count), default=0)
    blocks, query_blocks = -(-most // candidates) or 1, -(-most_asked // asked) or 1

    def deal(salt: int, n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")

    cand = rows.select("dim", deal(1, blocks).alias("block"), "vec_id", "x")
    ask = rows.where("asks").select("dim", deal(2, query_blocks).alias("query_block"), "vec_id", "x")

    def pairs(ask: DataFrame, first: int, last: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(first), F.lit(last)))
        one = ask.select(
            "dim", "query_block", each.alias("block"), F.lit(True).alias("is_query"), F.col("vec_id").alias("id"), "x", "least"
        )
        every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
        two = cand.where(F.col("block").between(first, last)).select(
            "dim", every.alias("query_block"), "block", F.lit(False).alias("is_query"), F.col("vec_id").alias("id"), "x",
            F.lit(float("-inf")).alias("least"),
        )
        return one.union(two)

    seeds = _best(_search(pairs(ask.withColumn("least", F.lit(float("-inf"))), 0, 0), k), k)
    if blocks == 1:
        return seeds.select("query_id", "rank", "vec_id", "score")
    seeds = written(seeds.select("query_id", "vec_id", "score", "rank"))
    least = seeds.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    ask = ask.join(least, ask["vec_id"] == least["query_id"], "left").withColumn(
        "least", F.coalesce("floor", F.lit(float("-inf")))
    )
    rest = _search(pairs(ask, 1, blocks - 1), k)
    return _best(rest.union(seeds.drop("rank")), k).select("query_id", "rank", "vec_id", "score")
