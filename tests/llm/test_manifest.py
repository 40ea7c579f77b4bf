"""The Merkle manifest against trees grown by hand."""

import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from patchloom.llm import merkle
from patchloom.session import local_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, r int, block string"


def h(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    parts = (doc_id, source, lang, n_chars, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def plain_tree(nodes):
    """(root, for each node the (before, after) texts of its runs)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            lo = at[i] // 8 * 8
            path.append(("".join(nodes[lo : at[i]]), "".join(nodes[at[i] + 1 : lo + 8])))
            at[i] //= 8
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows, changed):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = plain_leaf(doc_id, source, lang, n_chars, text)
        other = plain_leaf(doc_id, source, lang, n_chars, changed(doc_id, text))
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, other))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort()
        trees[g] = plain_tree([x[2] for x in groups[g]])
    root, tops = plain_tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (known, doc_id, leaf, other), path in zip(groups[g], trees[g][1]):
            node = other
            for before, after in path + top:
                node = h(before + node + after)
            proof = "".join(a + b for a, b in path + top)
            out.append((doc_id if known else None, leaf, trees[g][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def lowered(doc_id, text):
    import zlib

    hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
    return re.sub("[A-Z]", lambda m: m[0].lower(), text) if hit and text is not None else text


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest_of_many_layers(spark, depth):
    sizes = {None: 9, "": 1, "de": 8, "Z": 65, "é": 64, "a": 300, "zz": 7, "b": 1, "c": 2, "d": 20}
    rows, i = [], 2**53
    for lang, n in sizes.items():
        for k in range(n):
            rows.append((i, [f"Text {i}", None, "", "É Abc"][k % 4], lang, f"s{k % 2}" if k % 5 else None, k or None))
            i += 1
    rows += rows[:3] + [(None, "Null", "a", None, None), (None, "NULL", None, None, None), (2**53 + 1, "other", None, "s", 1)]
    rows += [(7, "same", "a", "s", 1)] * 20  # equal rows across runs
    df = local_table(spark, [(*r, "x", 3, "y") for r in rows], DOCS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle.manifest(df, F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text")), depth=depth)
    columns = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    got = sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)
    want = plain_manifest(rows, lowered)
    assert got == want
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_odd_tables(spark):
    assert merkle.manifest(local_table(spark, [], DOCS)).count() == 0
    one = merkle.manifest(local_table(spark, [(1, None, None, None, None, None, None, None)], DOCS)).first()
    leaf = plain_leaf(1, None, None, None, None)
    assert (one.leaf, one.subroot, one.root, one.proof, one.folded_root, one.verified) == (leaf, leaf, leaf, "", leaf, True)
    long = "é" * 200_000
    rows = [(1, long, "en", "s", 1, None, None, None), (2, long, "en", "s", 1, None, None, None)]
    assert {r.leaf for r in merkle.manifest(local_table(spark, rows, DOCS)).collect()} == {
        plain_leaf(i, "s", "en", 1, long) for i in (1, 2)
    }


def test_manifest_without_a_change_verifies(spark):
    rows = [(i, f"t{i}", "en", "s", i, None, None, None) for i in range(100)]
    found = merkle.manifest(local_table(spark, rows, DOCS), depth=1)
    assert found.where("not verified or altered_leaf <> leaf").count() == 0
    assert [r.place for r in found.orderBy("doc_id").collect()] == list(range(100))
