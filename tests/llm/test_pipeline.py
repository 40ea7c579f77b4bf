"""The pipeline and what its stages decide, against plain versions of all five stages."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from test_joins import DOCS, docs_of, plain_near
from test_text_operators import plain_secrets

import corpus_pipeline
from patchloom.llm import common, language, mixing, near_texts, secret_scan
from patchloom.llm.common import table
from patchloom.session import local_table, written, written_count

# -- plain versions: rows are (doc_id, text, lang, source, n_chars) -------------------------------


class PlainModel:
    """Context counts of each language, looked up byte by byte."""

    def __init__(self, rows):
        self.counts = defaultdict(lambda: defaultdict(Counter))
        for _, text, lang, *_ in rows:
            if text is not None and lang is not None:
                data = b"   " + text.lower().encode()
                for i in range(3, len(data)):
                    for order in range(4):
                        self.counts[lang][data[i - order : i]][data[i]] += 1
        self.memo = {}

    def cost(self, lang, gram):
        counts, bits, gone = self.counts[lang], 0.0, set()
        for order in (3, 2, 1, 0):
            seen = counts.get(gram[3 - order : 3])
            left = {b: n for b, n in (seen or {}).items() if b not in gone}
            if left:
                space = sum(left.values()) + len(left)
                if gram[3] in left:
                    return bits + math.log2(space / left[gram[3]])
                bits += math.log2(space / len(left))
            gone |= set(seen or {})
        return bits + math.log2(max(256 - len(counts[b""]), 1))

    def judge(self, text):
        """The language with the shortest code, its bits and the number of bytes; None without a letter."""
        if not any(map(str.isalpha, text or "")):
            return None
        data, best = b"   " + text.lower().encode(), None
        for lang in sorted(self.counts):
            bits = 0.0
            for i in range(3, len(data)):
                key = lang, data[i - 3 : i + 1]
                if key not in self.memo:
                    self.memo[key] = self.cost(*key)
                bits += self.memo[key]
            if best is None or bits < best[1]:
                best = lang, bits, len(data) - 3
        return best


def held_out(doc_id):
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain_language(rows):
    model = PlainModel([r for r in rows if not held_out(r[0])])
    codes = defaultdict(list)
    for doc_id, text, lang, *_ in rows:
        found = model.judge(text)
        if held_out(doc_id) and lang and found and found[0] == lang:
            codes[lang].append(found[1] / found[2])
    most = {k: language.MARGIN * sorted(v)[math.ceil(language.USUAL * len(v)) - 1] for k, v in codes.items()}
    out = []
    for doc_id, text, lang, source, n in rows:
        found = model.judge(text)
        if found and found[1] <= most.get(found[0], max(most.values())) * found[2] + language.SLACK_BITS:
            out.append((doc_id, text, lang or found[0], source, n))
    return out


def plain_dedup(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    return [rows[i] for i, _, _, kept in sorted(plain_near([r[1] for r in rows], 5)) if kept]


def plain_spans(text):
    """(start, kind, end, value) of base spans and of random tokens that none of them touches."""
    found = []
    for start, kind, end in plain_secrets(text or ""):
        value = re.search("[A-Za-z0-9+/_.=-]+$", text[start:end])[0] if kind == 0 else text[start:end]
        if kind == 0:  # the value may hold = itself: take it after the name's first separator
            value = re.match("[^:=]*[:=]\x20*[\"']?(.*)$", text[start:end], re.S)[1]
        found.append((start, kind, end, value))
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text or ""):
        if secret_scan.looks_random(m[0]) and not any(s < m.end() and m.start() < e for s, _, e, _ in found if _ is not None):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def plain_owners(rows):
    """value: (repositories, owners)."""
    spans = [plain_spans(r[1]) for r in rows]
    near = {i: part for i, _, part, _ in plain_near([r[1] for r in rows], 5)}
    held = defaultdict(set)
    for i, found in enumerate(spans):
        for *_, value in found:
            held[value].add((near[i], rows[i][3] or ""))
    out = {}
    for value, pairs in held.items():
        most = Counter(owner for _, owner in pairs)
        owner_of = {}
        for part, owner in sorted(pairs, key=lambda p: (-most[p[1]], p[1])):
            owner_of.setdefault(part, owner)
        out[value] = len(owner_of), len(set(owner_of.values()))
    return out


def plain_redact(rows):
    owners, out = plain_owners(rows), []
    for doc_id, text, lang, source, _ in rows:
        at, parts = 0, []
        for start, _, end, value in plain_spans(text):
            if owners[value][1] <= secret_scan.MAX_OWNERS and end > at:
                parts += [text[at:start], "[SECRET]"] if start >= at else []
                at = end
        clean = "".join(parts) + text[at:]
        out.append((doc_id, clean, lang, source, len(clean)))
    return out


def plain_mix(rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].encode())
    weight = {s: math.sqrt(n) for s, n in size.items()}
    scale = sum(size.values()) / sum(weight.values())
    out = []
    for r in rows:
        rate = weight[r[3]] * scale / size[r[3]] if size[r[3]] else 1.0
        assert rate <= mixing.PART
        key = "null" if r[0] is None else str(r[0])
        u = int(hashlib.md5(f"17:1:{key}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        times = 0
        while c <= u and times < 200:
            times += 1
            p *= rate / times
            c += p
        out += [r] * times
    return out


def plain_pieces(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    out = []
    for doc_id, text, lang, source, _ in rows:
        ids = model.encode(text, add_eos=True)
        out.append((doc_id, lang, source, tuple(ids), len(ids), model.decode(ids) == text))
    return out


PLAIN = dict(zip([n for n, _ in corpus_pipeline.STAGES], [plain_language, plain_dedup, plain_redact, plain_mix, plain_pieces]))

ITALIAN = """Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita.
Ahi quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura! Tant'è amara che
poco è più morte; ma per trattar del ben ch'i' vi trovai, dirò de l'altre cose ch'i' v'ho scorte."""
DANISH = """Der kom en soldat marcherende hen ad landevejen: én, to! én, to! Han havde sit tornyster på ryggen og en sabel
ved siden, for han havde været i krigen, og nu skulle han hjem. Så mødte han en gammel heks på landevejen; hun var så ækel,
hendes underlæbe hang hende lige ned på brystet."""
MARKUP = "<table><tr><td class='x1'>&nbsp;</td><td>{{}}</td></tr></table>" * 8


def planted(docs):
    """Rows beside the given ones for every decision that a stage takes."""
    rng = np.random.default_rng(5)
    words = sorted({w for r in docs for w in (r.text or "").split()})

    def text(n, seed):
        return " ".join(np.random.default_rng(seed).choice(words, n))

    noise = "".join(chr(c) for c in rng.integers(33, 127, 500))
    body, key, wide, quoted = text(60, 1), "api_key=Zx9Kq27LmP0aWv31", "token=Example77Key88Sample99", "passwd: horsebattery"
    rows = [
        (-1, None, None, None, 0), (-2, "12345 !!", None, "x", 0), (-3, "", None, None, 0), (-4, ITALIAN, None, "x", 0),
        (-5, DANISH, None, "x", 0), (-6, MARKUP, None, "x", 0), (-7, noise, None, "y", 0),
        (-10, body, None, "x", 0), (-10, text(50, 2), None, "x", 0), (-11, body, "en", "y", 0),
        (None, body, None, "y", 0), (None, text(40, 3), None, None, 0), (None, text(40, 3), None, None, 0),
        (-20, f"{text(30, 4)} {key} {text(30, 5)}", None, "x", 0),
    ]
    rows += [(-30 - i, f"{text(30, 10 + i)} {wide} {text(9, 20 + i)}", None, f"s{i}", 0) for i in range(4)]
    rows += [(-40 - i, f"{text(30, 30 + i)} {quoted} {text(9, 40 + i)}", None, f"s{i}", 0) for i in range(2)]
    return rows


def ordered(rows):
    return sorted(rows, key=repr)


def test_stages_equal_plain_versions(spark, sf):
    docs = table(spark, sf, "documents").select(*corpus_pipeline.COLUMNS)
    extra = planted(docs.collect())
    docs = docs.union(local_table(spark, extra, DOCS))
    rows, steps = [tuple(r) for r in docs.collect()], {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
        rows = PLAIN[name](rows)
        got = [tuple(tuple(c) if isinstance(c, list) else c for c in r) for r in docs.collect()]
        assert ordered(got) == ordered(rows), name
        steps[name] = rows
        if name != "pieces":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = {name: Counter(r[0] for r in found) for name, found in steps.items()}
    gone = {r[0] for r in extra} - set(ids["language"])
    assert gone == {-1, -2, -3, -4, -5, -6, -7}  # and no given document
    assert ids["near_duplicates"][-10] == 1 and ids["near_duplicates"][-11] == 1 and ids["near_duplicates"][None] == 1
    clean = {r[0]: r[1] for r in steps["secrets"]}
    assert "[SECRET]" in clean[-20] and "[SECRET]" in clean[-40] and "[SECRET]" in clean[-41]
    assert all("Example77Key88Sample99" in clean[-30 - i] for i in range(4))
    assert sum(ids["mixture"].values()) != sum(ids["secrets"].values()) or ids["mixture"] != ids["secrets"]


def test_run_applies_all_stages(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select(*corpus_pipeline.COLUMNS).collect()]
    for name in PLAIN:
        rows = PLAIN[name](rows)
    got = corpus_pipeline.run(spark, sf).collect()
    assert ordered((r.doc_id, r.lang, r.source, tuple(r.ids), r.n_tokens, r.restored) for r in got) == ordered(rows)


def test_stages_without_labels_or_rows(spark, sf):
    for texts in ([], [None, "a b", "1"]):
        docs = docs_of(spark, texts).selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf))
        assert {r.doc_id for r in docs.collect()} <= {1}


def test_verdicts_equal_plain_ownership(spark):
    rng = np.random.default_rng(12)
    values = ["token=Zx9Kq27LmP0aWv31", "secret: correcthorsebattery", "AKIA" + "QWERTYUIOPAS", "0123456789" * 4,
              "Q7wE9rT2yU4iO6pA8sD1fG3h", "passwd='12345678'"]
    rows = []
    for i in range(60):
        body = [f"w{x}" for x in rng.integers(0, 500, 40)]
        if i % 5 == 4:  # a copy or near copy of the document before, in another source
            body = rows[-1][1].split(" ")
            body[3] = f"n{i}"
            rows.append((i, " ".join(body), None, f"s{rng.integers(9)}", 0))
            continue
        for value in rng.choice(values[: 2 + i // 15], 2):
            body.insert(int(rng.integers(len(body))), value)
        rows.append((i, " ".join(body), None, f"s{rng.integers(1 + i // 8)}" if i % 7 else None, 0))
    rows += [rows[0]] * 3 + [(90, None, None, None, 0), (91, "", None, "s1", 0)]
    # columns whose names the operators use inside
    docs = local_table(spark, rows, DOCS).selectExpr("*", "1 as row", "2 as live", "3 as doc", "4 as value", "5 as _row", "6 as _live")
    unique = sorted({r[0]: r for r in rows}.values())
    owners = plain_owners(unique)
    want = {
        r[0]: [(s, k, e, owners[v][1] <= secret_scan.MAX_OWNERS, *owners[v]) for s, k, e, v in plain_spans(r[1])] for r in unique
    }
    got = secret_scan.scan(docs).collect()
    assert len(got) == len(rows)
    assert all([tuple(x) for x in r.spans] == want[r.doc_id] for r in got)
    verdicts = {x[3] for found in want.values() for x in found}
    assert verdicts == {True, False}
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    texts = {r[0]: r[1] for r in plain_redact([(a, b or "", c, d, e) for a, b, c, d, e in unique])}
    for r in clean.collect():
        assert (r.text or "") == texts[r.doc_id] and (r.row, r.live, r.doc, r.value, r._row, r._live) == (1, 2, 3, 4, 5, 6)


def test_dedup_of_repeated_ids_null_ids_and_clashing_names(spark):
    text, other = "a b c d e f g h", "k l m n o p q r"
    rows = [(5, text), (5, other), (5, text), (3, text), (None, other), (None, "t u v w x y"), (None, "t u v w x y"), (6, None), (6, "")]
    docs = local_table(spark, rows, "doc_id long, text string").selectExpr("*", "7 as row", "8 as doc", "9 as part", "1 as place")
    kept = near_texts.dedup(docs)
    assert kept.columns == docs.columns
    assert ordered((r.doc_id, r.text) for r in kept.collect()) == ordered(
        [(3, text), (5, other), (None, "t u v w x y"), (6, None), (6, "")]
    )
    assert near_texts.dedup(docs.where("doc_id > 9")).count() == 0


def test_stages_keep_only_what_their_results_read(spark, monkeypatch):
    text = "a b c d e f g h i token=Zx9Kq27LmP0aWv31"
    rows = [(i, text if i % 3 else f"t{i} u v w x y z", None, "s", 0) for i in range(60)]
    docs, clean = local_table(spark, rows, DOCS), text.replace("token=Zx9Kq27LmP0aWv31", "[SECRET]")
    for words in (common.SIFT_WORDS, 1):  # with one word, almost every row may be among the ids
        monkeypatch.setattr(common, "SIFT_WORDS", words)
        before = written_count()
        kept = near_texts.dedup(docs)
        assert written_count() - before == 2
        assert sorted(r.doc_id for r in kept.collect()) == [0, 1, *range(3, 60, 3)]
        before = written_count()
        redacted = secret_scan.redact(docs)
        assert written_count() - before == 1
        assert {r.doc_id: r.text for r in redacted.collect()} == {i: clean if i % 3 else t for i, t, *_ in rows}


def test_limits_without_labels_or_other_languages(spark):
    docs = docs_of(spark, ["a b c", "d e f"] * 40)
    learned = language.learn(docs)
    assert language.limits(docs.withColumn("lang", docs["lang"].substr(9, 9)).where("lang is null"), learned) == {}
    assert language.limits(docs, []) == {}
    limit = language.limits(docs, learned)
    assert set(limit) == {"en"} and limit["en"] > 0
    found = language.predict(docs_of(spark, ["a b c", None, "123", "q" * 400]), learned)
    kept = found.where(language.fits(limit)).select("doc_id").collect()
    assert [r.doc_id for r in kept] == [0]
