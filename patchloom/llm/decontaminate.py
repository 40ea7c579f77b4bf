"""Benchmark decontamination by winnowing, with DataFrame functions only.

The words of a text are hashed in runs of k, and of every w neighbouring runs the one
with the smallest hash is kept (the first, if several have it). Two texts that share
``w + k - 1`` words in a row keep the same run of that span, so texts without a kept
run in common share no span of that length. With ``w + k - 1`` the length of a window
that makes a document contaminated, joining the kept runs misses none.

Kept runs travel with the words around them, and those that meet a run of the
benchmark are extended: every window that holds the run is compared word for word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.session import written

WINDOW = 10
#: Low bits of a kept run that hold its place: texts of up to 2 ** 28 words.
PLACE_BITS = 28
#: Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z lowered and nothing else; ``lower`` does that, and faster, where all characters are ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    exact = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(plain, F.lower(text)).otherwise(exact)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words in order; none for null."""

    def inner(found: Column) -> Column:
        """Without the empty ends of a text that a separator begins or ends."""
        before = F.when(F.get(found, F.lit(0)) == "", 1).otherwise(0)
        after = F.when(F.element_at(found, -1) == "", 1).otherwise(0)
        return F.slice(found, before + 1, F.greatest(F.size(found) - before - after, F.lit(0)))

    found = F.split(F.coalesce(lowered(text), F.lit("")), SEPARATORS, -1)
    return _let(found, inner)


def _neighbours(values: Column, apart: int, join) -> Column:
    """``join(values[i], values[i + apart])`` for all i with both."""

    def pairs(v: Column) -> Column:
        n = F.greatest(F.size(v) - apart, F.lit(0))
        return F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(apart + 1), n), join)

    return _let(values, pairs)


def sizes(length: int) -> tuple[int, int]:
    """Words of a run and runs to keep one of, for spans of ``length`` words."""
    k = 1
    while 4 * k <= length:
        k *= 2
    return k, length - k + 1


def kept_runs(words: Column, length: int) -> Column:
    """Kept runs as hash (high bits) and place (low bits), distinct; none of shorter texts."""
    k, w = sizes(length)
    h = F.transform(words, lambda x: F.xxhash64(x, F.lit(length)))
    have = 1
    while have < k:
        h = _neighbours(h, have, lambda a, b: F.xxhash64(a, b))
        have *= 2
    high = F.lit(-1 << PLACE_BITS).cast("long")
    placed = F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long")))
    low, have = placed, 1
    while have < w:
        step = min(have, w - have)
        low = _neighbours(low, step, lambda a, b: F.least(a, b))
        have += step
    return F.array_distinct(low)


def run_hash(run: Column) -> Column:
    return F.shiftright(run, PLACE_BITS)


def _spans(words: Column, length: Column) -> Column:
    """All runs of ``length`` words, joined by a space; there must be one at least."""
    starts = F.sequence(F.lit(0), F.size(words) - length)
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, length), " "))


def benchmark_tables(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """The benchmark's kept runs (length, h), its windows (length, content, item), and the lengths of windows.

    There are at most ``window`` lengths; shorter ones are of items with fewer words.
    """
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    items = benchmark.select(item, words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = written(items.withColumn("length", F.least(F.size("words"), F.lit(window))))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect()) or [window]
    runs, windows = [], []
    for length in lengths:
        some = items.where(F.col("length") == length)
        content = _spans(F.col("words"), F.lit(length))
        runs.append(some.select("length", F.explode(kept_runs(F.col("words"), length)).alias("run")))
        windows.append(some.select("length", F.explode(F.array_distinct(content)).alias("content"), "item"))
    all_runs = reduce(DataFrame.union, runs).select("length", run_hash(F.col("run")).alias("h"))
    return written(all_runs.distinct()), written(reduce(DataFrame.union, windows).distinct()), lengths


def _key(text: Column) -> list[Column]:
    """Equal texts are looked at as one; 128 bits."""
    return [F.xxhash64(text, F.lit(1)).alias("key1"), F.xxhash64(F.lit(2), text).alias("key2")]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """What of every document is in the benchmark: doc_id, n_words, n_hit, items, contaminated.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are
    ignored. Words are lower-cased in A-Z. A window is ``window`` neighbouring words of
    an item, or all words of one that has fewer. A document's word is hit if it lies in
    an occurrence of a window; ``items`` are the ids, as sorted strings, of the items
    that have an occurring window. Null and empty texts have no words; items without
    words occur nowhere; items with one id are one item, and a null item_id is the empty
    string. There is a row per row of ``docs``, repeated or not.

    The first pass only asks which texts keep a run that the benchmark keeps. It
    exchanges a row per document if the benchmark's runs are small enough for Spark to
    broadcast, else hashes. The second one extends runs of those texts alone.
    """
    runs, windows, lengths = benchmark_tables(benchmark, window)
    text = docs.select("doc_id", "text")
    keys = ["key1", "key2"]
    words = words_of(F.col("text")).alias("words")

    marks = F.concat(*(kept_runs(F.col("words"), n) for n in lengths))
    about = ["row", "doc_id", *keys, "n_words"]
    read = text.select(F.monotonically_increasing_id().alias("row"), "doc_id", *_key(F.col("text")), words)
    read = read.withColumn("n_words", F.size("words").cast("long"))
    asked = read.select(*about, F.explode_outer(marks).alias("run")).select(*about, run_hash(F.col("run")).alias("h"))
    asked = asked.join(runs.select("h").distinct().withColumn("met", F.lit(True)), "h", "left")
    seen = written(asked.groupBy(about).agg(F.max(F.coalesce("met", F.lit(False))).alias("met")))

    suspects = seen.where("met").select(keys).distinct()
    near = text.select("text", *_key(F.col("text"))).join(suspects, keys, "left_semi").select(*keys, words)

    def around(length: int) -> Column:
        """Kept runs with the words of all windows that hold them."""
        w = sizes(length)[1]

        def one(r: Column) -> Column:
            place = r.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
            first = F.greatest(place - (w - 1), F.lit(0))
            some = F.slice("words", first + 1, place - first + length)
            return F.struct(F.lit(length).alias("length"), run_hash(r).alias("h"), first.alias("first"), some.alias("some"))

        return F.transform(kept_runs(F.col("words"), length), one)

    seeds = F.concat(*map(around, lengths))
    seeds = near.select(*keys, F.explode(seeds).alias("s")).select(*keys, "s.*")
    seeds = seeds.join(runs, ["length", "h"]).where(F.size("some") >= F.col("length"))
    spans = seeds.select(*keys, "length", "first", F.posexplode(_spans(F.col("some"), F.col("length"))).alias("i", "content"))
    spans = spans.select(*keys, "length", (F.col("first") + F.col("i")).alias("start"), "content")
    contents = windows.select("length", "content").distinct()
    hits = written(spans.join(contents, ["length", "content"]).distinct())

    part = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    reach = F.aggregate(
        F.array_sort(F.collect_list(part)),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["to"]), F.lit(0))).alias("n"),
            F.greatest(a["to"], x["end"]).alias("to"),
        ),
        lambda a: a["n"].cast("long"),
    )
    covered = hits.groupBy(keys).agg(reach.alias("n_hit"))
    named = hits.select(*keys, "length", "content").distinct().join(windows, ["length", "content"])
    named = named.select(*keys, "item").distinct().groupBy(keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = written(covered.join(named, keys))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return seen.join(found, keys, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), items.alias("items"), (n_hit > 0).alias("contaminated")
    )
