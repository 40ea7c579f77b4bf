"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give the base spans. Beside them a document may repeat the same
entity in a form that no pattern takes: a phone number without its plus sign, a
card number cut short, the name part of an address. Such mentions become nodes
of a random field together with the base spans. Neighbours in the text share a
chain potential, and mentions that look alike, however far apart, share a skip
potential; loopy message passing then makes the labels of a document consistent.

All potentials are counts over the whole corpus. A mention without a pattern is
never counted as an observed label: it is held to be the entity at the rate at
which base spans of its kind are mentioned again (a base span with another one of
its key counts as held back, others by expectation), and to be no personal data
at the rate at which documents without such an entity hold its key by chance.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from patchloom.llm.common import add_columns
from patchloom.operators.lookup import attach, bounded
from patchloom.session import written

KINDS = ("email", "ip", "card", "phone")
#: Label of a mention that is no personal data.
OTHER = len(KINDS)
#: Neighbours at most this many code points apart share a chain potential.
REACH = 40
ROUNDS, DAMPING, SETTLED = 50, 0.3, 1e-4
THRESHOLD = 0.5
#: Chance that a document holds a key of this sort before any is counted: seven digits, four numbers, a name.
CHANCE = {"d": 1e-7, "i": 1e-7, "n": 1e-4}
#: Pairs of neighbours that are added to observed and expected ones.
PRIOR = 10.0

# What the base kinds are made of.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

RUN = re.compile(r"[0-9]++(?:[\x20().-]{1,2}[0-9]++)*+")
WORD = re.compile(r"[A-Za-z0-9]++(?:[._-][A-Za-z0-9]++)*+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses by their signs: the longest local part before each, in time proportional to the text."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(LOCAL))
        after = DOMAIN.match(text, at + 1) if start < at else None
        if after:
            found.append((start, after.end()))
        floor = after.end() if after else at + 1
        at = text.find("@", floor)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base spans by kind and start; offsets are code points."""
    found = [(0, s, e) for s, e in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _keys(kind: int, text: str) -> list[str]:
    """What a mention is compared by: its last seven digits, its four numbers, or the name part of an address.

    The first letter says which (d, i, n).
    """
    if kind == 0:
        name = text.partition("@")[0].partition("+")[0].lower().strip("._%-")
        return ["n" + name] if len(name) >= 3 else []
    if kind == 1:
        return [_numbers(text)]
    digits = _digits(text)
    return ["d" + digits[-7:]] if len(digits) >= 7 else []


def _numbers(text: str) -> str:
    return "i" + ".".join(n.lstrip("0") or "0" for n in re.findall("[0-9]+", text))


def bare(text: str, digits: bool, names: bool):
    """(key, start, end) of everything that may be an entity without its pattern."""
    if digits:
        for m in RUN.finditer(text):
            found = _digits(m[0])
            if len(found) >= 7:
                yield "d" + found[-7:], m.start(), m.end()
            if 4 <= len(found) <= 12 and len(re.findall("[0-9]+", m[0])) == 4:
                yield _numbers(m[0]), m.start(), m.end()
    if names:
        for m in WORD.finditer(text):
            if m.end() - m.start() >= 3:
                yield "n" + m[0].lower(), m.start(), m.end()


def mentions(text: str) -> list[tuple[int, int, int, list[str]]]:
    """(start, end, label, keys) of base spans and of unlike mentions that share a key with one.

    A run with more digits than any base span of its key is cut to as many: the
    rest before them is another number. An unlike mention has the label OTHER
    here, which means that it was not observed.
    """
    base = base_spans(text)
    nodes = [(s, e, k, _keys(k, text[s:e])) for k, s, e in base]
    wanted: dict[str, int] = {}
    for s, e, _, keys in nodes:
        for key in keys:
            wanted[key] = max(wanted.get(key, 0), len(_digits(text[s:e])))
    if wanted:
        taken, at, last = sorted((s, e) for _, s, e in base), 0, -1
        sorts = {key[0] for key in wanted}
        hits = [(s, e, key) for key, s, e in bare(text, bool(sorts & {"d", "i"}), "n" in sorts) if key in wanted]
        for start, end, key in sorted(hits):
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if key[0] == "d" and len(_digits(text[start:end])) > wanted[key]:
                places = [i for i in range(start, end) if text[i] in "0123456789"]
                start = places[-wanted[key]]
            if start >= last and not any(s < end and start < e for s, e in taken[at : at + len(KINDS) + 1]):
                nodes.append((start, end, OTHER, [key]))
                last = end
    return sorted(nodes)


def links(nodes) -> list[tuple[int, int, int]]:
    """(0 chain or 1 skip, i, j): neighbours within reach, and each mention with the last one of the same key.

    Neighbours of the same key are one entity and have no chain link beside the skip.
    """
    found, last = [], {}
    for j, (start, _, _, keys) in enumerate(nodes):
        if j and start - nodes[j - 1][1] <= REACH and not set(keys) & set(nodes[j - 1][3]):
            found.append((0, j - 1, j))
        for key in keys:
            if key in last:
                found.append((1, last[key], j))
            last[key] = j
    return found


def beliefs(unary: np.ndarray, ends: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Marginals of a pairwise field by loopy sum-product.

    ``unary`` is nodes x labels, ``ends`` edges x 2, ``pair`` edges x labels x
    labels, all as logarithms. Messages are sent at once over all edges in both
    directions, damped, until they settle.
    """
    n, k = unary.shape
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    table = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
    message = np.full((len(source), k), -np.log(k))

    def total():
        out = unary.copy()
        np.add.at(out, target, message)
        return out

    for _ in range(ROUNDS):
        into = total()[source] - message[back]
        into = np.exp(into - into.max(1, keepdims=True))
        new = np.einsum("es,est->et", into, table)
        new = np.log(np.maximum(new / new.sum(1, keepdims=True), 1e-30))
        moved = np.abs(new - message).max(initial=0)
        message = (1 - DAMPING) * new + DAMPING * message
        if moved < SETTLED:
            break
    out = total()
    out = np.exp(out - out.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


NODE = "start:int,end:int,label:int,keys:array<string>"


def potentials(graphs: DataFrame) -> np.ndarray:
    """Logarithms of what label pairs of linked mentions count for, by kind of link (chain, skip).

    Only pairs of two base spans are counted. A chain pair has the ratio of its
    count to the one that independent neighbours would have, a skip pair the share
    of its second label beside the first. Pairs with "no personal data" have one.
    """
    edges = graphs.select("nodes", F.explode("edges").alias("e"))
    ends = [F.element_at("nodes", F.col(f"e.{c}") + 1)["label"] for c in "ij"]
    counts = edges.select("e.type", ends[0].alias("a"), ends[1].alias("b")).groupBy("type", "a", "b").count()
    n = np.zeros((2, OTHER, OTHER))
    for type_, a, b, count in counts.where(f"a < {OTHER} and b < {OTHER}").collect():
        n[type_, a, b] += count
        n[type_, b, a] += count
    pair = np.ones((2, OTHER + 1, OTHER + 1))
    expected = np.outer(n[0].sum(1), n[0].sum(0)) / max(n[0].sum(), 1)
    pair[0, :OTHER, :OTHER] = (n[0] + PRIOR) / (expected + PRIOR)
    same = n[1] + np.eye(OTHER) + 0.01
    pair[1, :OTHER, :OTHER] = same / same.sum(1, keepdims=True)
    return np.log(pair)


def chances(docs: DataFrame, graphs: DataFrame, keys: DataFrame) -> DataFrame:
    """``key`` and ``chance``: the share of documents without a base span of a key that hold the key all the same.

    Keys are looked for in all texts: where they are few, only those are sent on,
    otherwise all that a text holds, and equal ones are combined before they are
    shuffled.
    """
    few = bounded(keys)
    wanted = None if few is None else {r.key for r in few.collect()}
    digits = wanted is None or any(k[0] != "n" for k in wanted)
    names = wanted is None or any(k[0] == "n" for k in wanted)

    def start():
        def held(text):
            found = {k for k, _, _ in bare(text or "", digits, names) if wanted is None or k in wanted}
            return list(found - {k for kind, s, e in base_spans(text) for k in _keys(kind, text[s:e])}) if found else []

        return lambda texts: [[held(t) for t in texts]]

    held = add_columns(docs, ["text"], "keys array<string>", start).select(F.explode("keys").alias("key"))
    held = held.groupBy("key").agg(F.count("*").alias("held"))
    mine = graphs.select(F.array_distinct(F.flatten(F.transform("nodes", lambda x: x["keys"]))).alias("keys"))
    mine = mine.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("mine"))
    found = keys.join(held, "key", "left").join(mine, "key", "left").fillna(0, ["held", "mine"])
    prior = F.coalesce(*(F.when(F.col("key").startswith(k), c) for k, c in CHANCE.items()))
    others = F.greatest(F.lit(graphs.count()) - F.col("mine"), F.lit(0))
    return found.select("key", ((F.col("held") + prior) / (others + 1)).alias("chance"))


def again(graphs: DataFrame, open_: DataFrame) -> np.ndarray:
    """By kind, the share of entities in documents that are mentioned again, by iterated expectation.

    An entity is a key of base spans of one kind in one document. ``open_`` has the
    ``row``, ``key`` and ``chance`` of mentions without a pattern; their chances go
    to the driver as counts by hundredths of the logarithm.
    """
    base = graphs.select("row", F.explode("nodes").alias("x")).where(f"x.label < {OTHER}")
    base = base.select("row", F.col("x.label").alias("kind"), F.explode("x.keys").alias("key"))
    base = base.groupBy("row", "kind", "key").agg(F.count("*").alias("n"))
    sums = base.groupBy("kind").agg(F.count("*").alias("n"), F.sum((F.col("n") > 1).cast("long")).alias("again"))
    n, twice = np.zeros(OTHER), np.zeros(OTHER)
    for kind, count, more in sums.collect():
        n[kind], twice[kind] = count, more
    size = F.round(100 * F.log("chance")).cast("long").alias("size")
    bins = base.where("n = 1").join(open_, ["row", "key"]).groupBy("kind", size).count().collect()
    rate = np.full(OTHER, 0.5)
    for _ in range(ROUNDS):
        sure = twice.copy()
        for kind, log, count in bins:
            sure[kind] += count * rate[kind] / (rate[kind] + np.exp(log / 100))
        rate = (sure + 1) / (n + 2)
    return rate


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, base) of every row, sorted by kind and start.

    All base spans are there; a further mention is there with the label the
    field gives it, if that is not "no personal data" and its marginal is above
    the threshold. Null and empty texts have no spans, equal rows equal ones. Texts
    are never shuffled; they are read once, and again only if there are mentions
    without a pattern, for the chances of their keys. What is written are nodes and
    links, linear in the number of mentions.
    """
    edge = "array<struct<type:int,i:int,j:int>>"

    def start():
        def make(texts):
            nodes = [mentions(t) if t else [] for t in texts]
            return (
                [[dict(zip(("start", "end", "label", "keys"), x)) for x in ns] for ns in nodes],
                [[dict(zip(("type", "i", "j"), x)) for x in links(ns)] for ns in nodes],
            )

        return make

    docs = docs.select("doc_id", "text")
    graphs = add_columns(docs, ["text"], f"nodes array<struct<{NODE}>>, edges {edge}", start).drop("text")
    graphs = written(graphs.withColumn("row", F.monotonically_increasing_id()))
    open_ = graphs.select("row", F.explode("nodes").alias("x")).where(f"x.label = {OTHER}")
    open_ = open_.select("row", F.explode("x.keys").alias("key")).distinct()
    if open_.isEmpty():
        chance = graphs.withColumn("chance", F.lit(None).cast("map<string,double>"))
        rate = pair = None
    else:
        keys = written(open_.select("key").distinct())
        open_ = written(attach(open_, written(chances(docs, graphs, keys)), ["key"], ["row"], "inner"))
        rate, pair = again(graphs, open_), potentials(graphs)
        by_row = open_.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("key", "chance"))).alias("chance"))
        chance = graphs.join(by_row, "row", "left")

    def infer():
        def label(nodes, edges, chance):
            spans = [(n["label"], n["start"], n["end"], True) for n in nodes if n["label"] < OTHER]
            if len(spans) < len(nodes):
                chance = dict(chance)
                field = np.full((len(nodes), OTHER + 1), -30.0)
                for i, n in enumerate(nodes):
                    if n["label"] < OTHER:  # observed
                        field[i, n["label"]] = 0.0
                    else:
                        field[i] = np.log([*rate, chance[n["keys"][0]]])
                ends = np.array([(e["i"], e["j"]) for e in edges]).reshape(-1, 2)
                found = beliefs(field, ends, pair[[e["type"] for e in edges]])
                for n, b in zip(nodes, found):
                    if n["label"] == OTHER and b[:OTHER].max() > THRESHOLD:
                        spans.append((int(b[:OTHER].argmax()), n["start"], n["end"], False))
            return [dict(zip(("kind", "start", "end", "base"), s)) for s in sorted(spans)]

        return lambda nodes, edges, chance: [[label(*x) for x in zip(nodes, edges, chance)]]

    spans = "spans array<struct<kind:int,start:int,end:int,base:boolean>>"
    return add_columns(chance, ["nodes", "edges", "chance"], spans, infer).select("doc_id", "spans")
