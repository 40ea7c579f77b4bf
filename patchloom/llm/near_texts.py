"""Near duplicates among documents by circulant MinHash and exact verification.

A document is the set of its word shingles. Two permutations give its whole
signature: the first places a shingle in a ring, the second, shifted on by one
place for each coordinate, ranks it, so the ranks of a shingle are one stretch of
a table. Bands of the signature are buckets of candidates; whether two documents
are linked is decided on their full sets.

With 32 bands of 4 coordinates a pair at similarity 0.8 meets in no bucket with
probability (1 - 0.8 ** 4) ** 32, which is below 5e-8.

Inside a bucket not all pairs are listed. Every member is compared with the
bucket's hub (twice, the second time with the best linked one), and what is then
in one component needs no more comparisons. Only what is left undecided, members
of different components that were never compared, is compared block against block.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from patchloom.llm.common import add_columns, sift, stars
from patchloom.session import drop_written, written, written_count

BANDS, ROWS = 32, 4
RING = 1 << 20
#: Elements of sets that one task of a star compares with its hub, about; rows of a block.
STAR_ELEMENTS, BLOCK_ROWS = 2_000_000, 1024
MEMO = 50_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _Words()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words.

    A-Z are lowered, words end at ASCII white space. Fewer words are one shingle,
    no words none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    h = w[: len(w) - size + 1].copy()
    for j in range(1, size):
        h = h * _MIX + w[j : len(w) - size + 1 + j]
    return np.unique(mixed(h))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The placing permutation, and the ranking one as overlapping stretches of BANDS * ROWS places."""
    rng = np.random.default_rng(20)
    place = rng.permutation(RING).astype(np.uint32)
    rank = rng.permutation(RING).astype(np.uint32)
    ring = np.concatenate([rank, rank[: BANDS * ROWS]])
    return place, np.lib.stride_tricks.sliding_window_view(ring, BANDS * ROWS)


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest rank of a set under every shift."""
    place, stretches = _permutations()
    at = place[(found & np.uint64(RING - 1)).astype(np.int64)]
    parts = [stretches[at[i : i + 4096]].min(0) for i in range(0, len(at), 4096)]
    return np.minimum.reduce(parts)


def bands(found: np.ndarray) -> np.ndarray:
    """One bucket number per band; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    rows = signature(found).astype(np.uint64).reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        h = mixed(h * _MIX + rows[:, j])
    return h.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def alike(common, size_a, size_b, percent: int):
    return 100 * common >= percent * (size_a + size_b - common)


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, digest (h, g) of the set, and its bands."""

    def start():
        def make(texts):
            sets = [shingles(t, size) for t in texts]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            return [len(s) for s in sets], both[:, 0].copy(), both[:, 1].copy(), [bands(s) for s in sets]

        return make

    ddl = "n long, h long, g long, bands array<long>"
    return add_columns(docs.select("doc_id", "text"), ["text"], ddl, start).drop("text")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """rep, n, elements (sorted hashes as binary) of the documents with these ids.

    Few documents are candidates, so all others stay behind before the join.
    """

    def start():
        def make(texts):
            sets = [shingles(t, size) for t in texts]
            return [len(s) for s in sets], [s.tobytes() for s in sets]

        return make

    texts, _ = sift(docs.select(F.col("doc_id").alias("rep"), "text"), ids, "rep")
    chosen = texts.join(ids, "rep", "left_semi").dropDuplicates(["rep"])
    return add_columns(chosen, ["text"], "n long, elements binary", start).drop("text")


def _verify_stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones among pairs (hub, rep), as u and v.

    Sorted by hub, the hub's set comes first and is kept while its members go by,
    so a set is sent once per pair and batches stay small. Hubs with many members
    are dealt to several tasks.
    """
    sizes = sets.select("rep", "n")
    sized = pairs.join(sizes, "rep").join(sizes.select(F.col("rep").alias("hub"), F.col("n").alias("m")), "hub")
    sized = sized.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    sized = written(sized.select("hub", "rep", "n"))
    parts = sized.groupBy("hub").agg(F.ceil(F.sum("n") / STAR_ELEMENTS).cast("int").alias("parts"))
    dealt = sized.join(parts, "hub")
    dealt = dealt.select("hub", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep")
    members = dealt.join(sets, "rep").select("hub", "part", F.lit(1).alias("kind"), "rep", "elements")
    hubs = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hubs = hubs.join(sets, hubs["hub"] == sets["rep"])
    hubs = hubs.select("hub", "part", F.lit(0).alias("kind"), "rep", "elements")
    rows = hubs.union(members).repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")

    def run(batches):
        hub = None
        for batch in batches:
            u, v = [], []
            columns = (batch.column(i).to_pylist() for i in (2, 3, 4))
            for kind, rep, data in zip(*columns):
                found = np.frombuffer(data, np.uint64)
                if kind == 0:
                    hub, center = rep, found
                elif alike(overlap(center, found), len(center), len(found), percent):
                    u.append(hub)
                    v.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a block with each other."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = times[element] > 1
    owner, element = owner[shared], element[shared]
    kinds, column = np.unique(element, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, len(kinds), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        table = np.zeros((len(sets), 4096), np.float32)
        table[owner[a:b], column[a:b] - low] = 1
        table = table[:, table.any(0)]
        out += table @ table.T
    return out.astype(np.int64)


def forest(ok: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Edges of ``ok`` that join different ``part``s, as few as it takes."""
    labels = np.unique(part, return_inverse=True)[1]
    found = []
    i, j = np.nonzero(np.triu(ok & (labels[:, None] != labels), 1))
    for a, b in zip(i.tolist(), j.tolist()):
        if labels[a] != labels[b]:
            found.append((a, b))
            labels[labels == labels[b]] = labels[a]
    return found


def _verify_blocks(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members (band, rep, component) of a bucket that are in different components.

    Buckets with the same members are looked at once. A bucket is cut into blocks,
    every two blocks are a task, and a task returns no more links than it takes to
    join its components. The links are between components.
    """
    same = rest.groupBy("band").agg(
        F.count("*").alias("k"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"),
        F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)")).alias("t"),
    )
    same = same.groupBy("k", "s", "t").agg(F.min("band").alias("band"))
    blocks = same.select("band", F.ceil(F.col("k") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = rest.join(blocks, "band")
    block = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "component"
    )

    def run(key, t):
        sets = [np.frombuffer(x, np.uint64) for x in t.column("elements").to_pylist()]
        part = t.column("component").to_numpy()
        size = np.array([len(s) for s in sets])
        ok = alike(common_counts(sets), size[:, None], size, percent)
        edges = forest(ok, part)
        return pa.table({"u": part[[a for a, _ in edges]], "v": part[[b for _, b in edges]]})

    joined = rows.join(sets.select("rep", "elements"), "rep")
    return joined.groupBy("band", "low", "high").applyInArrow(run, "u long, v long")


def near_texts(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``size`` is the number of words of a shingle; documents link if ``percent`` of
    their shingles are common. Null texts and texts without words have no
    shingles and link with nothing. Rows with equal doc_id are one document; a
    null doc_id has no component and is not kept. An empty table gives an empty
    one, other columns are ignored.

    Documents with equal sets are one node, so exact copies cost no comparison.
    What is shuffled are sketches, the texts of candidates (and of few others, see
    ``sift``) once to take their sets, and sets of candidate pairs. Components found
    by one step are the nodes of the next one, and steps that have nothing to
    compare are left out.
    """
    sketches = written(_sketch(docs, size))
    rows = sketches.where("n > 0 and doc_id is not null")
    reps = rows.groupBy("h", "g").agg(F.min("doc_id").alias("rep"))
    nodes = written(rows.select("doc_id", "h", "g").join(reps, ["h", "g"]).select("doc_id", "rep"))
    judged = nodes.select(F.col("doc_id").alias("id"), F.col("rep").alias("component"))
    for parts in _steps(rows, nodes, docs, size, percent):
        judged = renamed(judged, parts)
    judged = judged.groupBy("id").agg(F.min("component").alias("c"))
    out = sketches.select("doc_id", "n").join(judged, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("c", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def _steps(rows: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> list[DataFrame]:
    """Tables (node, component) that name a node's component if they are applied one after the other."""
    chosen = nodes.where("doc_id = rep").select("rep").distinct()
    banded = rows.join(chosen, F.col("doc_id") == F.col("rep"), "left_semi")
    banded = banded.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band")).distinct()
    buckets = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("k")).where("k > 1")
    buckets = written(buckets)  # so that the join below is free to split a large bucket
    if buckets.isEmpty():
        return []
    full = written(banded.join(buckets, "band").select("band", "rep", "hub"))
    sets = written(_sets(docs, full.select("rep").distinct(), size))

    links = written(_verify_stars(full.where("rep <> hub").select("hub", "rep").distinct(), sets, percent))
    steps = [stars(links)]
    rest = full.where("rep <> hub").select("band", "rep", F.col("rep").alias("component"))
    rest = renamed(rest, steps[0])
    degree = links.select(F.col("u").alias("rep")).union(links.select(F.col("v").alias("rep")))
    degree = degree.groupBy("rep").agg(F.count("*").alias("degree"))
    ends = F.min("component").alias("low"), F.max("component").alias("high")
    place = F.struct(F.coalesce("degree", F.lit(0)), -F.col("rep"), F.col("component"))
    best = rest.join(degree, "rep", "left").groupBy("band").agg(F.max(place).alias("best"), *ends)
    best = best.where("low <> high")
    best = written(best.select("band", (-F.col("best.col2")).alias("hub"), F.col("best.component").alias("center")))
    if best.isEmpty():
        return steps
    rest = written(rest.join(best, "band"))
    pairs = rest.where("component <> center").select("hub", "rep", "center", "component").distinct()
    links = written(_verify_stars(pairs.select("hub", "rep"), sets, percent))
    rest = rest.where("rep <> hub").select("band", "rep", "component")
    if not links.isEmpty():
        found = links.select(F.col("u").alias("hub"), F.col("v").alias("rep")).join(pairs, ["hub", "rep"])
        steps.append(stars(found.select(F.col("center").alias("u"), F.col("component").alias("v"))))
        rest = renamed(rest, steps[-1])
    open_ = rest.groupBy("band").agg(*ends).where("low <> high").select("band")
    rest = written(rest.join(open_, "band", "left_semi"))
    if not rest.isEmpty():
        steps.append(stars(_verify_blocks(rest, sets, percent)))
    return steps


def renamed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` whose ``component`` is what ``parts`` (node, component) says of it, if anything."""
    parts = parts.select("node", F.col("component").alias("_now"))
    found = rows.join(parts, F.col("component") == F.col("node"), "left")
    return found.withColumn("component", F.coalesce("_now", "component")).select(*rows.columns)


def dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id (a null one last).

    Every row is compared under a number of its own, so rows with one doc_id and
    different texts are different documents, and copies among rows with a null
    doc_id go. Rows without words link with nothing and stay. Other columns of any
    name pass through. Of the texts of rows that stay hardly any are shuffled at the
    end, and of what was written on the way only the rows and the numbers of the
    dropped ones are left when this returns.
    """
    names, before = docs.columns, written_count()
    others = F.struct(*(c for c in names if c != "text")).alias("doc")
    rows = written(docs.select(others, "text", F.monotonically_increasing_id().alias("row")))
    found = near_texts(rows.select(F.col("row").alias("doc_id"), "text"), size, percent)
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("part"))
    place = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "row")
    placed = written(rows.select("row", place.alias("place")).join(found, "row"))
    first = placed.groupBy("part").agg(F.min("place")["row"].alias("row"))
    dropped = written(placed.select("row").join(first, "row", "left_anti"))
    drop_written(docs.sparkSession, since=before + 1, last=1)
    maybe, kept = sift(rows, dropped, "row")
    kept = kept.union(maybe.join(dropped, "row", "left_anti").select(*rows.columns))
    return kept.select(*(F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in names))
