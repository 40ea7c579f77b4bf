"""Language identification by prediction by partial matching.

Per language a tree of byte contexts up to three bytes deep is counted once and
frozen. A text's code length under a language is the sum over its bytes of the
exact cost in bits: the byte's frequency in the longest context, or an escape
(as many as the context has distinct followers) to the next shorter one, in
which the followers already ruled out are excluded. The shortest code wins.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.llm.common import add_columns

UNKNOWN = "und"
#: About so many labelled rows per language are learned from (all, if there are fewer).
SAMPLE_ROWS = 600
#: The most frequent four-byte sequences kept per language; bounds the size of the model.
MAX_NODES = 300_000
PAD = b"   "
#: About so many held out rows per language tell how long the codes of its texts are.
LIMIT_ROWS = 2000
#: A text fits a language if its code is no longer than ``SLACK_BITS`` (a key or number of 32 characters
#: in an otherwise usual text) beyond ``MARGIN`` times the bits a byte that the share ``USUAL`` of texts has.
USUAL, MARGIN, SLACK_BITS = 0.999, 1.5, 256.0
#: Bytes scored at a time, which bounds the memory that a long text takes.
CHUNK = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept for testing: crc32 of the id's text modulo 4 is 2. Null is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def grams_of(x: np.ndarray) -> np.ndarray:
    """For each byte but the first three the number of the last four, oldest first."""
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


def grams(text: str) -> np.ndarray:
    """``grams_of`` a text's bytes, in lower case and after ``PAD``."""
    return grams_of(np.frombuffer(PAD + text.lower().encode(), np.uint8).astype(np.uint32))


class Tree:
    """Frozen statistics of one language, as sorted arrays of contexts and followers."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.followers, self.contexts = [], []
        for order in range(4):  # contexts of 0 to 3 bytes
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            key, at = np.unique(keys & mask, return_inverse=True)
            n = np.bincount(at, counts)
            context, of = np.unique(key >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(of, n), np.bincount(of).astype(float)
            self.followers.append((key, n))
            self.contexts.append((context, total, kinds))
        # What a context's followers take away from the next shorter context.
        self.taken = [None]
        for order in range(1, 4):
            key, _ = self.followers[order]
            short, n = self.followers[order - 1]
            inside = n[np.searchsorted(short, key & np.uint32((1 << 8 * order) - 1))]
            context = self.contexts[order][0]
            self.taken.append(np.bincount(np.searchsorted(context, key >> np.uint32(8)), inside, len(context)))

    @staticmethod
    def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return at, table[at] == key

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of every four-byte sequence after its first three."""
        bits, open_ = np.zeros(len(gram)), np.arange(len(gram))
        taken, gone = np.zeros(len(gram)), np.zeros(len(gram))  # counts and kinds excluded so far
        for order in (3, 2, 1, 0):
            g = gram[open_] & np.uint32((1 << 8 * (order + 1)) - 1)
            context, total, kinds = self.contexts[order]
            at, there = self._find(context, g >> np.uint32(8))
            left, new = total[at] - taken[open_], kinds[at] - gone[open_]
            key, n = self.followers[order]
            k, seen = self._find(key, g)
            space = np.maximum(left + new, 1e-9)
            some = there & (new > 0)  # else nothing is left here: pass at no cost
            bits[open_] += np.where(some, np.log2(space) - np.log2(np.where(seen, n[k], np.maximum(new, 1e-9))), 0.0)
            if order:
                taken[open_] = np.where(there, self.taken[order][at], 0.0)
                gone[open_] = np.where(there, kinds[at], 0.0)
            open_ = open_[~(there & seen)]
        bits[open_] += np.log2(max(256 - len(self.followers[0][0]), 1))
        return bits


class Model:
    """Trees of all languages over one tree of all four-byte sequences they have seen."""

    def __init__(self, languages: list[str], counted: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.trees = [Tree(k, n) for k, n in counted]
        self.known = np.unique(np.concatenate([k for k, _ in counted]))
        self.bits = np.stack([t.cost(self.known) for t in self.trees], 1).astype(np.float32)
        # Paths down the tree: pairs, triples and all four bytes to their numbers, -1 where there is none.
        pairs, self.triples = np.unique(self.known >> np.uint32(16)), np.unique(self.known >> np.uint32(8))
        self.step2 = np.full(1 << 16, len(pairs), np.int32)
        self.step2[pairs] = np.arange(len(pairs))
        self.step3 = np.full((len(pairs) + 1) << 8, len(self.triples), np.int32)
        self.step3[self.step2[self.triples >> np.uint32(8)] << 8 | self.triples & np.uint32(255)] = np.arange(len(self.triples))
        self.step4 = np.full((len(self.triples) + 1) << 8, -1, np.int32)
        at = np.searchsorted(self.triples, self.known >> np.uint32(8))
        self.step4[at << 8 | self.known & np.uint32(255)] = np.arange(len(self.known))

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of ``data`` under each language."""
        found, data = np.zeros(len(self.languages)), PAD + data
        for at in range(0, len(data) - len(PAD), CHUNK):
            x = np.frombuffer(data[at : at + CHUNK + len(PAD)], np.uint8).astype(np.int32)
            node = self.step2[x[:-3] << 8 | x[1:-2]]
            node = self.step4[self.step3[node << 8 | x[2:-1]] << 8 | x[3:]]
            known = node >= 0
            found += self.bits[node[known]].sum(0, dtype=np.float64)
            if not known.all():
                gram, times = np.unique(grams_of(x.astype(np.uint32))[~known], return_counts=True)
                found += [float(t.cost(gram) @ times) for t in self.trees]
        return found


def _some(docs: DataFrame, rows: int) -> DataFrame | None:
    """About ``rows`` labelled texts per language, taken by a hash of the id; None if there are none."""
    docs = docs.where("lang is not null and text is not null")
    sizes = docs.groupBy("lang").count().collect()  # a row per language
    if not sizes:
        return None
    size = F.create_map(*(F.lit(v) for r in sizes for v in r))[F.col("lang")]
    place = F.pmod(F.xxhash64("doc_id", F.lit(71)), F.lit(1 << 30)) / float(1 << 30)
    return docs.where(place * size < rows).select("lang", "text")


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, nodes: int = MAX_NODES) -> list[tuple[str, bytes, bytes]]:
    """Counts per language from about ``rows`` labelled texts each, taken by a hash of the id.

    The number of labelled rows per language is counted over all of ``docs``; the
    share kept follows from it. Whole texts are counted on the executors; at most
    ``nodes`` sequences per language come to the driver.
    """
    chosen = _some(docs, rows)
    if chosen is None:
        return []

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                lang, text = (c.to_pylist() for c in batch.slice(at, 128).columns)
                for name in set(lang):
                    each = [grams(t) for l, t in zip(lang, text) if l == name]
                    key, n = np.unique(np.concatenate(each), return_counts=True)
                    columns = [pa.array([name] * len(key)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    got = counts.withColumn("i", F.row_number().over(order)).where(F.col("i") <= nodes).toPandas()
    return [
        (name, g["gram"].to_numpy(np.uint32).tobytes(), g["n"].to_numpy(np.int64).tobytes())
        for name, g in got.groupby("lang", sort=True)
    ]


@lru_cache(maxsize=1)
def _build(learned: tuple) -> Model:
    return Model(
        [x[0] for x in learned],
        [(np.frombuffer(k, np.uint32), np.frombuffer(n, np.int64)) for _, k, n in learned],
    )


def predict(docs: DataFrame, learned: list[tuple[str, bytes, bytes]]) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte``.

    Only the column ``text`` is looked at. ``score`` is the share of the best
    language if code lengths are read as probabilities. A text that is null, is
    empty or has no letter is ``und`` with score 0 and no bits, as is any text if
    nothing was learned. Equal code lengths go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(learned))

    def start():
        model = _build(shared.value) if shared.value else None

        def judge(text):
            if model is None or not text or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0, None
            data = text.lower().encode()
            bits = model.code_lengths(data)
            best = int(bits.argmin())
            score = 1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()
            return model.languages[best], float(score), float(bits[best] / len(data))

        return lambda texts: [*zip(*map(judge, texts))] if texts else [[], [], []]

    return add_columns(docs, ["text"], "lang_pred string, score double, bits_per_byte double", start)


def limits(docs: DataFrame, learned: list[tuple[str, bytes, bytes]], rows: int = LIMIT_ROWS) -> dict[str, float]:
    """Bits a byte up to which a text fits a language: ``MARGIN`` times the quantile ``USUAL`` of ``docs``.

    ``docs`` are labelled rows that nothing was learned from; about ``rows`` per
    language are coded, and those that are taken for their own language count. A
    language without such rows gets the largest limit of the others. Without any
    there are no limits.
    """
    chosen = _some(docs, rows)
    if chosen is None or not learned:
        return {}
    found = predict(chosen, learned).where(F.col("lang") == F.col("lang_pred"))
    usual = found.groupBy("lang").agg(F.percentile_approx("bits_per_byte", USUAL, 10_000).alias("bits")).collect()
    known = {r["lang"]: MARGIN * r["bits"] for r in usual}
    return {name: known.get(name, max(known.values())) for name, _, _ in learned} if known else {}


def fits(limit: dict[str, float], text: Column | str = "text") -> Column:
    """Whether a row of ``predict`` is a text of the language it was taken for.

    False for ``und``. Without limits every text fits that was taken for a language.
    """
    text = F.col(text) if isinstance(text, str) else text
    known = F.col("lang_pred") != UNKNOWN
    if not limit:
        return known
    most = F.create_map(*(F.lit(v) for pair in sorted(limit.items()) for v in pair))[F.col("lang_pred")]
    size = F.octet_length(F.lower(text))
    return known & F.coalesce(F.col("bits_per_byte") * size <= most * size + SLACK_BITS, F.lit(False))
