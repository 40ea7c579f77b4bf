"""Near duplicates among embeddings by spherical k-means cells.

Every vector has a home cell, that of the nearest centroid. Two unit vectors
within the linking distance d that lie on both sides of the plane between two
cells cannot both be farther than d / 2 from it, so a vector also visits every
cell whose plane to its home is that near. Then each link is between two rows
of one cell, at least one of them at home, and none is lost.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patchloom.llm.common import components
from patchloom.session import written

#: Vectors that the centroids are fitted on at most (by a hash of the id), vectors meant for a cell, and most cells.
SAMPLE_ROWS, CELL_ROWS, MAX_CELLS = 20_000, 2048, 1024
#: A task compares two blocks of rows at home, or one with so many blocks of guests. A block has an eighth of the rows of
#: its length, ``BLOCK_ROWS`` if that is less, and at most so many components. Within a task, tiles of rows are compared.
BLOCK_PARTS, BLOCK_ROWS, BLOCK_VALUES, GUESTS, TILE = 8, 2048, 1 << 21, 2, 2048
STEPS = 12
#: Cells that a vector is in on average at most; if it were more with more cells, there are fewer and larger ones.
MOST_VISITS = 4.0


def fit(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """At most ``k`` distinct unit centroids of the unit vectors ``x`` by spherical k-means."""
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(seed).permutation(len(c))[:k]]
    for _ in range(STEPS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return np.unique(c, axis=0)


def choose(x: np.ndarray, most: int, margin: float) -> np.ndarray:
    """Centroids in number a power of two up to ``most``, as many as keep visits of the sample ``x`` rare."""
    best, k = fit(x, 1), 2
    while k <= most:
        more = fit(x, k)
        if cells_of(x, more, margin)[1].sum(1).mean() > MOST_VISITS:
            break
        best, k = more, 2 * k
    return best


def cells_of(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and which cells it is in (rows x cells), its home among them."""
    dot = x @ c.T
    home = dot.argmax(1)
    apart = np.linalg.norm(c[:, None] - c[None], axis=2) if len(c) <= 64 else np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
    inside = dot.max(1, keepdims=True) - dot <= (margin + 1e-7) * apart[home]
    inside[np.arange(len(x)), home] = True
    return home, inside


def unit(flat: np.ndarray, rows: int) -> np.ndarray:
    """Rows as unit vectors; scaled by the largest component first, so that no square over- or underflows."""
    x = flat.reshape(rows, -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(x: np.ndarray, y: np.ndarray, least: float, same: bool, cosines):
    """Numbers of the rows of ``x`` and of ``y`` that link with any of the other, and which of them link, as a matrix.

    ``x`` and ``y`` are unit vectors in single precision; ``same`` says that both are one
    tile. Where a product is so close to ``least`` that single precision cannot decide,
    ``cosines(i, j)`` does for rows ``i`` of ``x`` and ``j`` of ``y``.
    """
    dot, slack = x @ y.T, (x.shape[1] + 8) * 2.0**-23
    if same:
        np.fill_diagonal(dot, -2)
    rows = np.flatnonzero(dot.max(1) >= least - slack)
    dot = dot[rows]
    columns = np.flatnonzero(dot.max(0, initial=-2) >= least - slack)
    dot = dot[:, columns]
    ok = dot >= least
    i, j = np.nonzero(np.abs(dot - least) <= slack)
    step = max(BLOCK_VALUES // x.shape[1], 1)
    for at in range(0, len(i), step):
        close = i[at : at + step], j[at : at + step]
        ok[close] = cosines(rows[close[0]], columns[close[1]]) >= least
    return rows, columns, ok


def parts_of(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row number of the left side for every left and right row: the first of its part of the graph, or -1."""
    left, right = np.full(ok.shape[0], -1), np.full(ok.shape[1], -1)
    fresh = ok.any(1)
    while fresh.any():
        root = int(fresh.argmax())
        rows = np.zeros(len(left), bool)
        rows[root] = True
        while rows.any():
            left[rows] = root
            columns = ok[rows].any(0) & (right < 0)
            right[columns] = root
            rows = ok[:, columns].any(1) & (left < 0)
        fresh &= left < 0
    return left, right


def rows_of_block(n: int, dim: int) -> int:
    """Rows of a block of ``n`` vectors of length ``dim``."""
    return min(max(-(-n // BLOCK_PARTS), BLOCK_ROWS), max(BLOCK_VALUES // dim, 1))


def near_vectors(
    vectors: DataFrame, least: float = 0.95, cell_rows: int = CELL_ROWS, block_rows: int | None = None
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``vectors`` has vec_id and ``embedding`` (array of numbers). A vector that is
    null or zero, or has a null or non-finite component or no components, links
    with nothing; vectors of different lengths do not link. Of rows with equal
    vec_id one is looked at; a null vec_id gives n_links 0, no component, kept false.

    Equal vectors are one row with a number of copies, so a vector that holds a
    third of the table costs one comparison. Cells are cut into blocks of
    bounded size and any two blocks are compared in a task of their own, tile by
    tile, which returns counts and one edge per row of a tile, not pairs. Rows are
    copied to as many tasks as there are blocks in their cell, a number that does not
    grow with the table before blocks of an eighth of it are at their bound. Products
    are of single precision; close ones are repeated in double precision. Centroids come from a sample
    of at most ``SAMPLE_ROWS`` vectors per length; they decide on work, not on links.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").alias("x"))
    rows = rows.where("vec_id is not null").dropDuplicates(["vec_id"])
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = rows.where(F.col("x").isNotNull() & ~bad & F.exists("x", lambda v: v != 0))
    valid = valid.select("vec_id", "x", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(9), "x").alias("g"))
    ids = valid.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    members = written(valid.select("vec_id", "h", "g").join(ids, ["h", "g"]).select("vec_id", "rep", "copies"))
    first = members.where("vec_id = rep").select("vec_id", "copies")
    reps = written(valid.select("vec_id", "x", F.size("x").alias("dim")).join(first, "vec_id"))

    margin = np.sqrt(max(2 - 2 * least, 0)) / 2
    centroids, of_block = {}, {}
    for dim, n in sorted(reps.groupBy("dim").count().collect()):
        place = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
        some = reps.where((F.col("dim") == dim) & (place * n < SAMPLE_ROWS)).orderBy("vec_id").limit(SAMPLE_ROWS)
        got = some.select("x").toPandas()["x"].to_list() or reps.where(F.col("dim") == dim).limit(1).toPandas()["x"].to_list()
        x = unit(np.concatenate(got), len(got))
        of_block[dim] = block_rows or rows_of_block(n, dim)
        centroids[dim] = choose(x, min(n // cell_rows, MAX_CELLS), margin)
    shared = spark.sparkContext.broadcast(centroids)

    def deal(batches):
        names = ["dim", "cell", "vec_id", "copies", "home", "visits", "x"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                dims = part.column(2).to_numpy()
                for dim in np.unique(dims):
                    one = part.filter(pa.array(dims == dim))
                    lists = one.column(1)
                    home, inside = cells_of(unit(lists.flatten().to_numpy(), one.num_rows), shared.value[dim], margin)
                    row, cell = np.nonzero(inside)
                    visits = pa.array([np.flatnonzero(v).tolist() for v in inside], pa.list_(pa.int32()))
                    taken = pa.array(row)
                    columns = [
                        pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)),
                        one.column(0).take(taken), one.column(3).take(taken),
                        pa.array(home[row].astype(np.int32)), visits.take(taken), lists.take(taken),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    kind = reps.schema["x"].dataType.simpleString()
    schema = f"dim int, cell int, vec_id long, copies long, home int, visits array<int>, x {kind}"
    dealt = reps.select("vec_id", "x", "dim", "copies").mapInArrow(deal, schema)
    at_home = F.col("home") == F.col("cell")
    most = F.create_map(*(F.lit(v) for pair in of_block.items() for v in pair))[F.col("dim")] if of_block else F.lit(1)
    sizes = dealt.groupBy("dim", "cell").agg(
        F.ceil(F.count_if(at_home) / most).cast("int").alias("homes"),
        F.ceil(F.count_if(~at_home) / (GUESTS * most)).cast("int").alias("guests"),
    )
    sizes = written(sizes.where("homes > 0"))  # a row per cell
    n = F.when(at_home, F.col("homes")).otherwise(F.col("guests"))
    placed = dealt.join(sizes, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(4)), n).cast("int"))
    block, homes = F.col("block"), F.col("homes")
    as_home = F.transform(
        F.sequence(F.lit(0), homes + F.col("guests") - 1),
        lambda i: F.struct(
            F.when(i < homes, F.greatest(block, i)).otherwise(block).alias("one"),
            F.when(i < homes, F.least(block, i)).otherwise(i).alias("two"),
            ((i <= block) | (i >= homes)).alias("first"),
        ),
    )
    as_guest = F.transform(
        F.sequence(F.lit(0), homes - 1),
        lambda i: F.struct(i.alias("one"), (homes + block).alias("two"), F.lit(False).alias("first")),
    )
    paired = placed.withColumn("p", F.explode(F.when(at_home, as_home).otherwise(as_guest)))
    paired = paired.select("dim", "cell", "p.*", "vec_id", "copies", "home", "visits", "x")

    def run(key, t):
        cell, one, two = (v.as_py() for v in key[1:])
        first = t.column("first").to_numpy()
        order = np.argsort(t.column("vec_id").to_numpy(), kind="stable")
        a, b = order[first[order]], order[~first[order]]
        same = one == two
        b = a if same else b
        flat = t.column("x").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        x = np.empty(flat.shape, np.float32)
        for at in range(0, t.num_rows, TILE):
            x[at : at + TILE] = unit(flat[at : at + TILE], len(flat[at : at + TILE]))
        ids, copies, home = (t.column(c).to_numpy() for c in ("vec_id", "copies", "home"))
        visits = t.column("visits").combine_chunks()
        out = [(ids[:0], copies[:0], ids[:0])]
        for i, j in product(range(0, len(a), TILE), range(0, len(b), TILE)):
            if same and j < i:
                continue
            p, q, twice = a[i : i + TILE], b[j : j + TILE], same and i == j
            cosines = lambda r, c, p=p, q=q: (unit(flat[p[r]], len(r)) * unit(flat[q[c]], len(c))).sum(1)
            rows, columns, ok = compare(x[p], x[q], least, twice, cosines)
            p, q = p[rows], q[columns]
            if len(p) and len(q) and home[q[0]] != cell:  # guests: does a row at home visit their home, and is that to count it?
                cells = visits.take(pa.array(p))
                inside = np.zeros((len(p), len(shared.value[key[0].as_py()])), bool)
                inside[np.repeat(np.arange(len(p)), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()] = True
                ok &= ~(inside[:, home[q]] & (home[q] < cell))
            left, right = parts_of(ok)
            for side, n, root in ((p, ok @ copies[q], left), (q, ok.T @ copies[p] * (not twice), right)):
                out.append((ids[side][root >= 0], n[root >= 0], ids[p[root[root >= 0]]]))
        return pa.table(dict(zip(("vec_id", "links", "root"), map(np.concatenate, zip(*out)))))

    schema = "vec_id long, links long, root long"
    found = paired.groupBy("dim", "cell", "one", "two").applyInArrow(run, schema)
    found = written(found)
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    judged = members.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left")
    judged = judged.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("vec_id").alias("id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("component", "rep").alias("c"),
    )
    all_ids = vectors.select("vec_id").join(judged, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("c", "vec_id")
    return all_ids.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
