"""Merkle manifest of a dataset by exchange of superblocks.

Documents are leaves. Within a group (a language) they are numbered by id, and every
``ARITY`` consecutive nodes become one, until one is left; the groups' roots become
one root the same way. A superblock is ``ARITY ** depth`` consecutive nodes.

On the way up a superblock becomes one node, which is a leaf of the next, much
smaller layer. On the way down the nodes of a superblock are cogrouped with the one
row of outer nodes that their proofs share, which is all that lies above: the group
then finishes its own part of the tree, joins the proofs and folds the altered
leaves up to the root. No task holds more than a superblock and one proof.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.session import written

ARITY, DEPTH = 8, 4
#: Documents' columns that a leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUNS = "array<struct<at:int,others:array<string>>>"
OUTER = f"g long, block long, path {RUNS}, own string, subroot string, root string"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(encoded(columns[c]) for c in FIELDS)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``r`` (place in the group by ``order``, from 0) and ``n`` (rows of the group).

    Rows are dealt to ranges of (group, order), which are written with the number of
    their range, so that a task that runs again finds the same ones. A place is the
    place within the range and the rows of the group in earlier ranges; there is no
    window over a group. Equal rows are told apart by a running id, so that a range
    may end among them.
    """
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(group, *order, "_tie").withColumn("_range", F.spark_partition_id())
    ranged = written(ranged)
    each = Window.partitionBy("_range", group).orderBy(*order, "_tie")
    here = ranged.withColumn("_i", F.row_number().over(each).cast("long") - 1)
    counts = written(ranged.groupBy(group, "_range").agg(F.count("*").alias("_k")))  # a row per range and group in it
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_g"), F.col("_range").alias("_p"),
        F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"),
        F.sum("_k").over(Window.partitionBy(group)).alias("n"),
    )
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_p"))
    return here.join(offsets, same).withColumn("r", F.col("_i") + F.col("_before")).drop(
        "_tie", "_range", "_i", "_g", "_p", "_before"
    )


def grown(nodes: list[str], total: int, depth: int) -> list[list[str]]:
    """All levels over the nodes of a superblock, themselves first, in a group of ``total`` nodes.

    A superblock with other ones beside it always grows by ``depth`` levels, even from
    a single node; the only one of a group grows to the group's root.
    """
    levels = [nodes]
    while len(levels) <= depth if total > ARITY**depth else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def path_of(levels: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """Place in its run and the run's others, level by level, of node ``i``."""
    out = []
    for level in levels[:-1]:
        first, at = i - i % ARITY, i % ARITY
        run = level[first : first + ARITY]
        out.append((at, run[:at] + run[at + 1 :]))
        i //= ARITY
    return out


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """What ``node`` becomes with the others of its runs."""
    for at, others in path:
        node = digest([*others[:at], node, *others[at:]])
    return node


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"r div {ARITY**depth}"))


def _shrink(nodes: DataFrame, depth: int) -> DataFrame:
    """The layer above ``nodes`` (g, r, n, node): a row per superblock."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        total = int(t["n"].iloc[0])
        top = grown(t.sort_values("r")["node"].tolist(), total, depth)[-1][0]
        above = -(-total // ARITY**depth)
        return pd.DataFrame({"g": t["g"].iloc[:1], "r": t["block"].iloc[:1], "n": [above], "node": [top]})

    return written(_blocks(nodes, depth).groupBy("g", "block").applyInPandas(run, "g long, r long, n long, node string"))


def _layers(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """``nodes`` and the layers above, up to the one that has a row per group, its root."""
    layers = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        layers.append(_shrink(layers[-1].select("g", "r", "n", "node"), depth))
        most = -(-most // ARITY**depth)
        if most <= 1:
            return layers


def _paths(layers: list[DataFrame], outer: DataFrame, depth: int) -> DataFrame:
    """From what lies above the groups' roots, what lies above every node of the first layer.

    ``outer`` has a row per group, as if that were one superblock, the result one per
    node: g, block (the node's place), path (the runs above it), own (the node), subroot,
    root. A layer has a row per superblock of the layer below.
    """

    def run(key: tuple, t: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("r")
        levels = grown(t["node"].tolist(), int(t["n"].iloc[0]), depth)
        top = _path(above)
        paths = [[{"at": a, "others": o} for a, o in path_of(levels, i) + top] for i in range(len(t))]
        return pd.DataFrame({
            "g": t["g"].values, "block": t["r"].values, "path": paths, "own": t["node"].values,
            "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0],
        })

    for layer in reversed(layers):
        pair = _blocks(layer, depth).groupBy("g", "block").cogroup(outer.groupBy("g", "block"))
        outer = written(pair.applyInPandas(run, OUTER))
    return outer


def _path(above: pd.DataFrame) -> list[tuple[int, list[str]]]:
    """The runs above a superblock, from its row of outer nodes."""
    return [(p["at"], list(p["others"])) for p in above["path"].iloc[0]]


def manifest(
    docs: DataFrame, altered: Column | None = None, group: str = "lang", depth: int = DEPTH
) -> DataFrame:
    """Leaves, roots and proofs of all documents, and what an altered copy of the text would give.

    ``docs`` has the columns of ``FIELDS``; others are ignored. Result, a row per row of
    ``docs``: doc_id, ``group``, place (from 0), leaf, subroot, root, proof (the others
    of all runs, level by level, left to right), altered_leaf (with ``altered`` for the
    text), folded_root (the altered leaf folded with the proof) and verified (whether
    that is the root). All digests are lowercase hex.

    Nulls are encoded apart from empty texts; a null ``group`` is a group, the first one;
    null ids come first. Rows with equal ids follow each other by their leaves, and equal
    rows are leaves of their own. Groups are in bytewise order. An empty table has no rows.
    ``depth`` decides on the size of tasks, not on results.
    """
    columns = {c: F.col(c) for c in FIELDS}
    other = columns["text"] if altered is None else altered
    changed = ~columns["text"].eqNullSafe(other)
    leaves = docs.select(
        "doc_id", F.col(group).alias("_group"), leaf(columns).alias("node"),
        F.when(changed, leaf(columns | {"text": other})).alias("changed"),
    )
    placed = numbered(written(leaves), "_group", ["doc_id", "node"])
    groups = placed.where("r = 0").select(F.col("_group").alias("_name"), F.lit(0).alias("_all"))
    names = written(numbered(groups, "_all", ["_name"]).select("_name", F.col("r").alias("g")))
    placed = placed.join(names, F.col("_group").eqNullSafe(F.col("_name"))).drop("_name")
    # pandas has no whole numbers beside nulls, so ids go through it as text
    kinds = {"doc_id": docs.schema["doc_id"].dataType, group: docs.schema[group].dataType}
    as_text = {c: F.col(c).cast("string") for c in ("doc_id", "_group")}
    placed = written(placed.withColumns(as_text))

    layers = _layers(placed, depth)
    of_all = [F.lit(0).cast("long").alias("g"), F.col("g").alias("r"), F.lit(names.count()).cast("long").alias("n"), "node"]
    tops = _layers(layers[-1].select(*of_all), depth)
    first = F.lit(0).cast("long").alias("block")
    root = [F.col("node").alias(c) for c in ("own", "subroot", "root")]
    top = tops[-1].select("g", first, F.array().cast(RUNS).alias("path"), *root)
    above = _paths(tops[:-1], top, depth)
    above = above.select(F.col("block").alias("g"), first, "path", "own", F.col("own").alias("subroot"), "root")
    above = _paths(layers[1:-1], above, depth)

    def run(key: tuple, t: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("r")
        levels = grown(t["node"].tolist(), int(t["n"].iloc[0]), depth)
        top = _path(above)
        end = "".join("".join(others) for _, others in top)
        subroot, root = above["subroot"].iloc[0], above["root"].iloc[0]
        altered = [c if isinstance(c, str) else node for node, c in zip(levels[0], t["changed"])]
        lifted: dict[str, str] = {}
        proofs, folded = [], []
        for i, node in enumerate(altered):
            own = path_of(levels, i)
            inner = fold(node, own)
            if inner not in lifted:
                lifted[inner] = fold(inner, top)
            proofs.append("".join("".join(others) for _, others in own) + end)
            folded.append(lifted[inner])
        return pd.DataFrame({
            "doc_id": t["doc_id"].values, "_group": t["_group"].values, "place": t["r"].values, "leaf": levels[0],
            "subroot": subroot, "root": root, "proof": proofs, "altered_leaf": altered, "folded_root": folded,
            "verified": [f == root for f in folded],
        })

    schema = (
        "doc_id string, _group string, place long, leaf string, subroot string, root string, proof string,"
        " altered_leaf string, folded_root string, verified boolean"
    )
    pair = _blocks(placed, depth).groupBy("g", "block").cogroup(above.groupBy("g", "block"))
    found = pair.applyInPandas(run, schema)
    ids = [F.col("doc_id").cast(kinds["doc_id"]).alias("doc_id"), F.col("_group").cast(kinds[group]).alias(group)]
    return found.select(*ids, *(c for c in found.columns if c not in ("doc_id", "_group")))
