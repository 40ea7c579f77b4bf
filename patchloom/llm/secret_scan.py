"""Secret scan with corpus-wide ownership of every candidate.

Candidates are the values that the base patterns find, and long mixed tokens
beside them. How many repositories (distinct documents) and owners (sources of
those) hold the same value decides what it is: one that more than ``MAX_OWNERS``
owners hold in documents of their own is a copied example, all others are live.
Ownership alone decides, for words, digits and random characters alike; only which
tokens are candidates beside the base patterns is a matter of how they look.
Copies and near copies of a document are one repository with one owner, in
however many sources they lie: copying a document does not make its keys examples.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import sha256

from pyspark.sql import DataFrame, functions as F

from patchloom.llm import near_texts
from patchloom.llm.common import add_columns, sift
from patchloom.session import drop_written, written, written_count

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "token")

# The patterns of the three base kinds.
ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Documents that have so many percent of their shingles of so many words in common are copies.
SHINGLE_WORDS, PERCENT = 5, 80
#: A value with more owners is widely copied; an owner and someone who quotes it are not enough.
MAX_OWNERS = 2

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of all base spans; offsets are code points.

    A hexadecimal run is matched from its first character, so asking for 32 of
    them finds the same spans as taking whole runs and dropping short ones.
    """
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def looks_random(value: str) -> bool:
    """Letters and digits mixed, with at least 3 bits of entropy per character."""
    n = len(value)
    if n < 8 or not re.search("[0-9]", value) or not re.search("[A-Za-z]", value):
        return False
    return sum(c / n * math.log2(n / c) for c in Counter(value).values()) >= 3.0


def added_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random looking tokens of 20 or more characters that no base span touches."""
    found, ends, at = [], [(s, e) for s, _, e, _ in base], 0
    for m in TOKEN.finditer(text):
        if looks_random(m[0]):
            while at < len(ends) and ends[at][1] <= m.start():
                at += 1
            if not any(s < m.end() and m.start() < e for s, e in ends[at:at + 3]):
                found.append((m.start(), 3, m.end(), m[0]))
    return found


FIELDS = ("start", "kind", "end", "value")
DDL = "start:long,kind:int,end:long,value:string"


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """All candidates of a text in order: start, kind, end, digest of the value."""
    base = base_spans(text or "")
    found = sorted(base + added_spans(text or "", base))
    return [(s, k, e, sha256(v.encode()).hexdigest()[:32]) for s, k, e, v in found]


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``found``: what ``find`` says of the text; a text without candidates becomes null."""

    def start():
        def look(texts):
            found = [[dict(zip(FIELDS, x)) for x in find(text)] for text in texts]
            return [t if f else None for t, f in zip(texts, found)], found

        return look

    return add_columns(docs, ["text"], f"text string, found array<struct<{DDL}>>", start)


def holders(kept: DataFrame) -> DataFrame:
    """``value``, ``repositories`` and ``owners`` of every candidate of ``kept`` (row, source, text, found).

    Rows with one ``row`` are equal. Of documents that hold a value of several
    rows, near copies are one repository. A repository that lies in several sources
    counts for that of them that holds the value in most repositories (the first
    by name, if several do), so owners are few where few sources explain all.
    Counts are combined before they are shuffled, and joins may be split where a
    value is common.
    """
    each = kept.select("row", F.coalesce("source", F.lit("")).alias("owner"), F.explode("found.value").alias("value"))
    each = written(each.distinct())
    shared = each.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    rows = written(each.join(written(shared), "value").select("row").distinct())
    if rows.isEmpty():
        parts = rows.select("row", F.col("row").alias("part"))
    else:
        texts = kept.join(rows, "row", "left_semi").select(F.col("row").alias("doc_id"), "text").dropDuplicates(["doc_id"])
        parts = near_texts.near_texts(texts, SHINGLE_WORDS, PERCENT)
        parts = parts.select(F.col("doc_id").alias("row"), F.col("component_id").alias("part"))
    held = each.join(written(parts), "row", "left").withColumn("part", F.coalesce("part", "row"))
    held = written(held.select("value", "part", "owner").distinct())
    most = held.groupBy("value", "owner").agg(F.count("*").alias("n"))
    named = held.join(most, ["value", "owner"]).groupBy("value", "part")
    named = named.agg(F.min(F.struct(-F.col("n"), "owner"))["owner"].alias("owner"))
    named = named.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return named.groupBy("value").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Spans of every document with the verdict of the corpus: columns of ``docs`` less text, ``spans``.

    ``spans`` is sorted by start and kind: (start, kind, end, live, repositories,
    owners). All candidates are listed, live or not. A value is live if it has at
    most ``max_owners`` owners, as ``holders`` counts them. A null text has no spans,
    a null source counts as one owner, columns but these three of ``docs`` are not
    returned. The join with the
    verdicts may be split where a value is common. Digests and offsets are
    shuffled, and texts only of documents that share a value with others.
    """
    docs = docs.select("doc_id", "text", "source")
    kept = written(candidates(docs).withColumn("row", F.monotonically_increasing_id()))
    each = kept.select("row", F.explode("found").alias("x")).select("row", "x.*")
    live = F.col("owners") <= max_owners
    judged = each.join(written(holders(kept)), "value").withColumn("live", live)
    span = F.struct("start", "kind", "end", "live", "repositories", "owners")
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    out = kept.drop("found", "text").join(spans, "row", "left")
    return out.withColumn("spans", F.coalesce("spans", empty)).drop("row")


def redact(docs: DataFrame, max_owners: int = MAX_OWNERS, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with live spans in ``text`` replaced by ``mark``; overlapping ones become one mark.

    Live is meant as in ``scan``. Copied examples and everything else stay; no row
    is dropped and null texts stay null. Equal rows share their verdicts. Other
    columns of any name pass through. Texts are shuffled only of documents with live
    spans (and of few others, see ``sift``), and of what was written on the way only
    the live values of those documents are left when this returns.
    """
    names, before = docs.columns, written_count()
    doc = F.struct(*(c for c in names if c != "text")).alias("doc")
    keyed = docs.select(doc, "text", F.xxhash64("doc_id", "source", "text").alias("row"))
    kept = candidates(keyed.select("row", F.col("doc.source").alias("source"), "text"))
    kept = written(kept.where(F.size("found") > 0))
    live = holders(kept).where(F.col("owners") <= max_owners).select("value")
    each = kept.select("row", F.explode("found.value").alias("value")).distinct()
    hit = written(each.join(written(live), "value").groupBy("row").agg(F.collect_set("value").alias("live")))
    drop_written(docs.sparkSession, since=before, last=1)
    maybe, others = sift(keyed, hit.select("row"), "row")

    def start():
        def clean(text, live):
            at, parts = 0, []
            for s, _, e, value in find(text):
                if value in live and e > at:
                    parts += [text[at:s], mark] if s >= at else []
                    at = e
            return "".join(parts) + text[at:]

        return lambda texts, live: [[clean(t, set(v)) if v else t for t, v in zip(texts, live)]]

    clean = add_columns(maybe.join(hit, "row", "left"), ["text", "live"], "text string", start)
    clean = clean.select("doc", "text").union(others.select("doc", "text"))
    return clean.select(*(F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in names))
