"""Removal of repeated passages by suffix automata of reference shards.

A window of ``size`` words is repeated if its words also start anywhere else in
the corpus. Sending every document past an automaton of every shard would be a
product of the corpus with itself, so shards are made by content: a window belongs
to its anchor, the run of ``ANCHOR`` words in it with the smallest hash, and
windows with equal words have equal anchors. A region is a run of neighbouring
windows of a document with one anchor. Anchors that occur once are done with. The
regions of the others are the reference: those of a shard of anchors go into one
suffix automaton, and the regions are streamed through it for their matching
statistics; a window is repeated if its match is ``size`` words long in a state
that ends at more than one place.

Equal regions are one with a weight, and an anchor with a single region needs no
automaton to be counted. An anchor with very many different regions is spread
over several automata, whose counts per window are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from patchloom.llm.common import add_columns, small_batches
from patchloom.llm.near_texts import _MIX, _WORDS, mixed
from patchloom.session import written

ANCHOR = 8
#: Words of a shard's automaton, about, and different regions of an anchor beyond which it is spread.
SHARD_WORDS, HOT_REGIONS = 200_000, 2000


class SuffixAutomaton:
    """All substrings of the sequences added, with the weight of the places where each ends."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, steps: dict[int, int], link: int) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of ``q`` for the shorter strings that reach it from ``p``."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], weight: int = 1) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # known from an earlier sequence
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
            else:
                p, last = last, self._state(self.length[last] + 1, {}, 0)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            self.places[last] += weight

    def count(self) -> None:
        """Adds up places along the links; to be called once, when all is added."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[state]] += self.places[state]

    def matches(self, words: list[int], size: int) -> list[int]:
        """For each word the places of the last ``size`` words up to it, 0 where the match is shorter."""
        out, state, length = [], 0, 0
        nexts, link, lengths, places = self.next, self.link, self.length, self.places
        for word in words:
            step = nexts[state].get(word)
            while step is None and state:
                state = link[state]
                length = lengths[state]
                step = nexts[state].get(word)
            if step is not None:
                state, length = step, length + 1
                if length >= size:
                    while lengths[link[state]] >= size:
                        state = link[state]
                    length = size
            out.append(places[state] if length >= size else 0)
        return out


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def regions(w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of all regions of a document's word hashes."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(w) < size:
        return none
    span = min(ANCHOR, size)
    h = w[: len(w) - span + 1].copy()
    for j in range(1, span):
        h = h * _MIX + w[j : len(w) - span + 1 + j]
    h = mixed(h)
    each = np.lib.stride_tricks.sliding_window_view(h, size - span + 1)
    at = np.concatenate([each[i : i + 65536].argmin(1) + i + np.arange(len(each[i : i + 65536])) for i in range(0, len(each), 65536)])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[at[first]], first, np.diff(np.r_[first, len(at)])


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    """A row per region: anchor, content (a hash of its words), key, lo, n."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, keys = [], part.column(0).to_numpy()
                for i, text in enumerate(part.column(1).to_pylist()):
                    w = word_hashes(text)
                    anchor, lo, n = regions(w, size)
                    data, ends = w.tobytes(), lo + n + size - 1
                    content = [xxhash.xxh3_64_intdigest(data[8 * a : 8 * b]) for a, b in zip(lo.tolist(), ends.tolist())]
                    found.append((anchor, np.array(content, np.uint64), np.full(len(lo), keys[i]), lo, n))
                anchor, content, key, lo, n = (np.concatenate(c) for c in zip(*found))
                columns = [anchor.view(np.int64), content.view(np.int64), key, lo.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["anchor", "content", "key", "lo", "n"])

    schema = "anchor long, content long, key long, lo int, n int"
    return docs.select(_key().alias("key"), "text").mapInArrow(run, schema)


def _count_shards(reference: DataFrame, size: int) -> DataFrame:
    """Runs of repeated windows of every region: anchor, content, first, last.

    ``reference`` has anchor, content, weight, shard, part, words. Where ``part``
    is null the shard has all regions of its anchors. Otherwise it has some, and
    counts of equal windows are summed over the parts.
    """

    def run(key, t):
        whole = key[1].as_py() is None
        automaton = SuffixAutomaton()
        words = [np.frombuffer(x, np.uint64) for x in t.column("words").to_pylist()]
        lists = [w.tolist() for w in words]
        for w, weight in zip(lists, t.column("weight").to_pylist()):
            automaton.add(w, weight)
        automaton.count()
        out = []
        for i, w in enumerate(lists):
            places = np.array(automaton.matches(w, size)[size - 1 :])
            if whole:
                again = np.diff(np.r_[0, places > 1, 0])
                out += [(i, a, b - 1, None, 0) for a, b in zip(np.flatnonzero(again > 0), np.flatnonzero(again < 0))]
            else:
                data = words[i].tobytes()
                windows = (xxhash.xxh3_64_intdigest(data[8 * j : 8 * (j + size)]) for j in range(len(places)))
                out += [(i, j, j, h - (1 << 63), int(places[j])) for j, h in enumerate(windows)]
        at, first, last, window, count = zip(*out) if out else ((),) * 5
        take = pa.array(at, pa.int64())
        return pa.table({
            "anchor": t.column("anchor").take(take), "content": t.column("content").take(take),
            "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32()),
            "window": pa.array(window, pa.int64()), "count": pa.array(count, pa.int64()),
            "part": pa.array([key[1].as_py()] * len(at), pa.int64()),
        })

    schema = "anchor long, content long, first int, last int, window long, count long, part long"
    found = written(reference.groupBy("shard", "part").applyInArrow(run, schema))
    spread = found.where("window is not null")
    # All regions of a part that have a window come with the same count of it.
    local = spread.groupBy("anchor", "window", "part").agg(F.max("count").alias("count"))
    total = local.groupBy("anchor", "window").agg(F.sum("count").alias("total")).where("total > 1")
    spread = spread.join(total.select("anchor", "window"), ["anchor", "window"], "left_semi")
    names = ["anchor", "content", "first", "last"]
    return found.where("window is null").select(*names).union(spread.select(*names))


def repeated_spans(docs: DataFrame, size: int) -> DataFrame:
    """Word ranges that repeated windows cover: key (hash of doc_id and text), spans (start, end)."""
    small_batches(docs.sparkSession)
    sketch = written(_sketch(docs, size))
    counts = sketch.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    counts = written(counts)  # so that the join below is free to split a frequent anchor
    places = written(sketch.join(counts, "anchor"))
    kinds = places.groupBy("anchor", "content").agg(
        F.count("*").alias("weight"), F.min(F.struct("key", "lo", "n")).alias("at")
    )
    kinds = written(kinds)
    anchors = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    total = kinds.join(anchors, "anchor").agg(F.sum(F.col("at.n") + size - 1).alias("w")).first()["w"] or 0
    shards = int(-(-total // SHARD_WORDS)) or 1

    hot = F.col("kinds") > HOT_REGIONS
    part = F.when(hot, F.pmod(F.col("content"), F.ceil(F.col("kinds") / HOT_REGIONS).cast("long")))
    shard = F.when(hot, F.col("anchor")).otherwise(F.pmod("anchor", F.lit(shards)))
    wanted = kinds.join(anchors, "anchor").select(
        F.col("at.key").alias("key"),
        F.struct("anchor", "content", "weight", shard.alias("shard"), part.alias("part"), "at.lo", "at.n").alias("r"),
    )
    wanted = wanted.groupBy("key").agg(F.collect_list("r").alias("wanted"))
    texts = docs.select(_key().alias("key"), "text").join(wanted, "key")
    texts = texts.dropDuplicates(["key"]).select("text", "wanted")
    fields = ["anchor", "content", "weight", "shard", "part"]

    def take(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, words = [], []
                for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    w = word_hashes(text)
                    rows += wanted
                    words += [w[r["lo"] : r["lo"] + r["n"] + size - 1].tobytes() for r in wanted]
                out = [pa.array([r[f] for r in rows], pa.int64()) for f in fields]
                yield pa.RecordBatch.from_arrays([*out, pa.array(words, pa.binary())], [*fields, "words"])

    ddl = ", ".join(f"{f} long" for f in fields) + ", words binary"
    found = _count_shards(written(texts.mapInArrow(take, ddl)), size)

    only = places.join(anchors, "anchor", "left_anti")
    only = only.select("key", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + size - 1).alias("end"))
    some = places.join(found, ["anchor", "content"])
    some = some.select("key", (F.col("lo") + F.col("first")).alias("start"), (F.col("lo") + F.col("last") + size).alias("end"))
    return only.union(some).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """``docs`` with n_words, n_removed and ``kept``: the words that no repeated window of ``size`` covers.

    Words are runs without ASCII white space, unchanged; kept words are joined by
    one space. All copies of a repeated passage go, also within one document, as
    windows are judged on the input. Rows are documents: repeated rows repeat each
    other. Null and empty texts have no words and keep an empty text; an empty
    table stays empty; columns of these names are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept", "_key", "_spans")
    spans = repeated_spans(docs, size).select(F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    joined = docs.withColumn("_k", _key()).join(spans, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")

    def start():
        def cut(text, spans):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            if not spans:
                return len(words), 0, b" ".join(words).decode()
            np.add.at(gone, [s["start"] for s in spans], 1)
            np.add.at(gone, [s["end"] for s in spans], -1)
            left = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
            return len(words), len(words) - len(left), b" ".join(left).decode()

        return lambda texts, spans: [*zip(*map(cut, texts, spans))] if texts else [[], [], []]

    return add_columns(joined, ["text", "_spans"], "n_words long, n_removed long, kept string", start).drop("_spans")
