"""Operators that work on each text: chat, personal data, language, secrets, pieces, mixing."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from patchloom.llm import chat, language, mixing, pii, piece_bpe, queries, secret_scan
from patchloom.llm.common import table
from patchloom.session import local_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **extra):
    rows = [(i, t, None, f"s{i % 3}", 0) for i, t in enumerate(texts)]
    return local_table(spark, rows, DOCS)


ODD = [None, "", " \n\t ", "x", "same", "same", "é中😀 \x00 ▁", "word " * 20_000]


# -- chat ---------------------------------------------------------------------------------------


def test_events_fold_to_final_messages(spark):
    log = local_table(
        spark,
        [
            ("c", 1, "message", 1, "user", "hi"),
            ("c", 2, "delta", 2, "assistant", "wrong "),
            ("c", 3, "delta", 2, None, "answer"),
            ("c", 4, "regenerate", 2, None, None),
            ("c", 5, "delta", 2, None, "right "),
            ("c", 6, None, 2, None, "answer"),
            ("c", 7, "edit", 1, None, "hello"),
            ("c", 8, "delta", 1, None, "!"),
            (None, 1, "message", 1, None, None),
        ],
        "conv_id string, seq long, event string, message long, role string, text string",
    )
    got = {(r.conv_id, r.message): (r.position, r.role, r.text) for r in chat.fold_events(log).collect()}
    assert got == {("c", 1): (1, "user", "hello!"), ("c", 2): (2, "assistant", "right answer"), (None, 1): (1, "", "")}


def test_chat_reads_back_what_it_wrote(spark):
    texts = [
        r"\### Assistant: </turn> ok", "\n</turn>\n### user:\n", "\\", "\\\\### ", "", None, " x\n", "### a:\n\n</turn>\n",
        "é😀" * 5000, r"\</turn>\\",
    ]
    rows = [(c, i, role, t) for c in (1, None) for i, (t, role) in enumerate(zip(texts, ["user", "assistant", "a:\n\\<#", None, ""] * 2))]
    turns = local_table(spark, rows, "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.fold_events(chat.log_of_turns(turns)))
    got = {(r.conv_id, r.i): (r.role, r.text, r.learned) for r in chat.read_back(formatted).collect()}
    want = {(c, i): (role or "", t or "", (t or "") if role == "assistant" else None) for c, i, role, t in rows}
    assert got == want
    for r in formatted.collect():
        for span, t in zip(r.loss, texts):
            assert span is None or len(r.formatted[span.start : span.end]) >= len(t or "")


def test_chat_ties_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first")]
    formatted = chat.render(chat.fold_events(chat.log_of_turns(local_table(spark, rows, schema))))
    read = sorted(chat.read_back(formatted).collect(), key=lambda r: r.i)
    assert [r.text for r in read] == ["first", "a", "a", "b"]
    assert chat.render(chat.fold_events(chat.log_of_turns(local_table(spark, [], schema)))).count() == 0


# -- personal data ------------------------------------------------------------------------------


def plain_pii(text):
    def luhn(d):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in twice) % 10 == 0

    def spans(pattern, ok):
        return [(m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m[0])]

    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [
        spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        spans(r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, s, e) for k, one in enumerate(found) for s, e in one]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("12. -+()@aZ%\n٣", max_size=60), st.text("4929 .-+(", max_size=60), st.text(max_size=40)))
def test_pii_base_spans(text):
    assert pii.base_spans(text) == plain_pii(text)


def test_pii_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "@" * 300_000, "1." * 100_000, "+1" + " " * 300_000):
        pii.base_spans(text)


def test_pii_field_labels_repeated_mentions(spark):
    call = "Call +1 (706) 555-3138 today. "
    texts = [call + "Or (706) 555-3138 at night.", "clean 123 text", *ODD] + [call + call] * 20
    got = {r.doc_id: [(x.kind, x.base) for x in r.spans] for r in pii.find(docs_of(spark, texts)).collect()}
    assert got[0] == [(3, False), (3, True)] or got[0] == [(3, True), (3, False)]
    assert got[1] == [] and all(got[i] == [] for i in range(2, 2 + len(ODD)))
    assert got[20] == [(3, True)] * 2
    assert pii.find(docs_of(spark, [])).count() == 0


def test_pii_field_labels_bare_forms_wherever_they_are_common(spark):
    """No base span is repeated anywhere; each document has one base and one bare form."""
    rng = np.random.default_rng(5)
    texts, want = [], []
    for i in range(300):
        a, b, c = (int(x) for x in rng.integers(200, 999, 3))
        base, other, kind = [
            (f"+1 ({a}) {b}-{c}{i % 10}", f"({a}) {b}-{c}{i % 10}", 3),
            (f"{a % 250}.{b % 250}.{c % 250}.{i % 250}", f"{a % 250}-{b % 250}-{c % 250}-{i % 250}", 1),
            (f"smith{chr(97 + i % 26)}{chr(97 + a % 26)}{chr(97 + b % 26)}@a.com", f"smith{chr(97 + i % 26)}{chr(97 + a % 26)}{chr(97 + b % 26)}", 0),
        ][i % 3]
        texts.append(f"write to {base} now, and it is long since anybody had an answer there. Or {other} at night")
        want.append([(kind, texts[-1].index(base), True), (kind, texts[-1].rindex(other.lstrip("(")), False)])
    # An ordinary word that is also the name of an address is as common without the address.
    texts += ["mail support@a.com for support"] + ["mail office@a.com today"] * 300 + ["our support is good"] * 600
    want += [[(0, 5, True)]] + [[(0, 5, True)]] * 300 + [[]] * 600
    got = {r.doc_id: [(x.kind, x.start, x.base) for x in r.spans] for r in pii.find(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(want))


def test_pii_field_without_repeats_in_a_single_document(spark):
    got = pii.find(docs_of(spark, ["Call +1 (706) 555-3138 today. Or (706) 555-3138 at night."])).first().spans
    assert [(x.kind, x.base) for x in got] == [(3, True), (3, False)]


def test_pii_query_counts_base_spans_by_kind(spark, tmp_path):
    five = "1.2.3.4 10.0.0.1 8.8.8.8 9.9.9.9 7.7.7.7"
    texts = [five, "joe@x.com and joe", "+1 (706) 555-3138, 4111 1111 1111 1111, a@b.c", five + " a@b.c d@e.f", None, ""]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.QUERIES["op3_pii_crf"](spark, str(tmp_path)).collect():
        spans = plain_pii(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in spans) for i in range(4)]
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_pii_bare_number_is_cut_from_a_longer_run():
    text = "card 4845168114407329, then 7536784127813050 4845168114407329 again"
    assert [(text[s:e], k) for s, e, k, _ in pii.mentions(text)] == [("4845168114407329", 2), ("4845168114407329", pii.OTHER)]


def test_beliefs_are_marginals_of_a_tree():
    rng = np.random.default_rng(1)
    unary, pair = rng.normal(size=(3, 2)), rng.normal(size=(2, 2, 2))
    ends = np.array([[0, 1], [1, 2]])
    joint = np.exp(
        unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + pair[0][:, :, None] + pair[1][None]
    )
    joint /= joint.sum()
    want = np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))])
    assert np.allclose(pii.beliefs(unary, ends, pair), want, atol=1e-3)


# -- language -----------------------------------------------------------------------------------


def test_code_lengths_are_probabilities():
    """In every context the costs of all 256 bytes sum to one, exclusion and escapes included."""
    keys, n = np.unique(language.grams("abracadabra, a banana and a cabana"), return_counts=True)
    tree = language.Tree(keys, n)
    for context in (b"abr", b"zab", b"xyz", b"xxa", b"ana"):
        gram = np.uint32(int.from_bytes(context + b"\0", "big")) + np.arange(256, dtype=np.uint32)
        assert np.exp2(-tree.cost(gram)).sum() == pytest.approx(1)


def test_code_length_by_hand():
    keys, n = np.unique(language.grams("ab"), return_counts=True)
    tree = language.Tree(keys, n)
    seen = tree.cost(np.array([int.from_bytes(b"   a", "big")], np.uint32))
    assert seen[0] == pytest.approx(1)  # once, against one escape
    # Escapes from "  a", " a" and "a" pass through contexts with one follower each, "b" being excluded below.
    other = tree.cost(np.array([int.from_bytes(b"  aa", "big")], np.uint32))
    assert other[0] == pytest.approx(1 + 0 + 0 + 1)  # escape, twice nothing left, then "a" against its escape


def test_model_agrees_with_its_trees():
    a, b = (np.unique(language.grams(t), return_counts=True) for t in ("the cat sat on the mat", "der hund und die katze"))
    model = language.Model(["a", "b"], [a, b])
    text = "the dog und die maus"
    want = [t.cost(language.grams(text)).sum() for t in model.trees]
    assert np.allclose(model.code_lengths(text.encode()), want, rtol=1e-5)


def test_language_accuracy_on_held_out_rows(spark):
    got = queries.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    docs = local_table(spark, [(i, t, "en" if i > 5 else None, None, 0) for i, t in enumerate(ODD)], DOCS)
    learned = language.learn(docs)
    rows = {r.doc_id: r for r in language.predict(docs.withColumnRenamed("n_chars", "score"), learned).collect()}
    assert [rows[i].lang_pred for i in range(len(ODD))] == ["und"] * 3 + ["en"] * 5
    assert rows[0].score == 0 and rows[7].score == 1
    assert {r.lang_pred for r in language.predict(docs, []).collect()} == {"und"}
    assert language.predict(docs_of(spark, []), learned).count() == 0


# -- secrets ------------------------------------------------------------------------------------


def plain_secrets(text):
    assign = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


PARTS = st.sampled_from(
    ["password", "PassWd", "ſecret", "api_key", "toKen", "apikey", "=", ":", " ", '"', "'", "AKIA", "A1B2C3D4E5F6", "deadbeef" * 4, "a", "Z9", "é", "0f"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_secret_base_spans(text):
    assert [x[:3] for x in secret_scan.base_spans(text)] == plain_secrets(text)


def test_ownership_tells_examples_from_live_secrets(spark):
    live, copied = "token=Zx9Kq27LmP0aWv31", "token=Example77Key88Sample99"
    texts = [f"a {copied} b", f"c {copied} d", f"e {live} f", f"g {live} h", *ODD]
    owners = ["s0", "s1", "s2", "s2"] + [None] * len(ODD)
    rows = [(i, t, None, o, 0) for i, (t, o) in enumerate(zip(texts, owners))]
    docs = local_table(spark, rows, DOCS)
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs, max_owners=1).collect()}
    assert [(x.live, x.owners, x.repositories) for x in got[0]] == [(False, 2, 2)]
    assert [(x.live, x.owners, x.repositories) for x in got[2]] == [(True, 1, 2)]
    assert len(got) == len(rows) and all(got[i] == [] for i in range(4, len(rows)))
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, max_owners=1).collect()}
    assert clean == {i: (f"{t[0]} [SECRET] {t[-1]}" if i in (2, 3) else t) for i, t in enumerate(texts)}
    assert secret_scan.scan(docs_of(spark, [])).count() == 0


def test_copies_of_a_document_do_not_make_its_secrets_examples(spark):
    live, token, copied = "api_key=Zx9Kq27LmP0aWv31", "Q7wE9rT2yU4iO6pA8sD1fG3h", "token=Example77Key88Sample99"
    words = [f"w{i}" for i in range(120)]
    body = " ".join(words[:60] + [live, token] + words[60:])
    near = body.replace("w59 ", "v59 ").replace(" w60", " v60")  # changed right beside the values
    own = [f"{copied} {' '.join(f'{c}{i}' for i in range(30))}" for c in "abc"]
    texts = [body] * 6 + [near] * 3 + own
    rows = [(i, t, None, f"s{i}", 0) for i, t in enumerate(texts)]
    docs = local_table(spark, rows, DOCS)
    got = {r.doc_id: [(x.kind, x.live, x.repositories, x.owners) for x in r.spans] for r in secret_scan.scan(docs).collect()}
    want = [[(0, True, 1, 1), (3, True, 1, 1)]] * 9 + [[(0, False, 3, 3)]] * 3
    assert got == dict(enumerate(want))
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    gone = [t.replace(live, "[SECRET]").replace(token, "[SECRET]") for t in texts]
    assert {i: t.replace("api_key=", "") for i, t in clean.items()} == dict(enumerate(gone))


def test_copied_tokens_are_listed_with_their_verdict(spark):
    token = "Q7wE9rT2yU4iO6pA8sD1fG3h"
    rows = [(i, f"{c} {token} {c}", None, f"s{i}", 0) for i, c in enumerate("abc")]
    got = [[(x.kind, x.live, x.owners) for x in r.spans] for r in secret_scan.scan(local_table(spark, rows, DOCS)).collect()]
    assert got == [[(3, False, 3)]] * 3


# -- pieces -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return piece_bpe.PieceTable(model), sentencepiece.SentencePieceProcessor(model_proto=model)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("abct hein  ▁\n.,()-=\"'é中😀\x00019_ABTHE<>/", max_size=60)))
def test_pieces_equal_the_library(pieces, text):
    ours, library = pieces
    ids = library.encode(text, add_eos=True)
    assert ours.encode(text).tolist() == ids
    assert ours.decode(ids) == library.decode(ids)


def test_pairs_of_pieces_are_judged_by_the_merges_of_each(pieces, monkeypatch):
    ours, merging, calls = pieces[0], pieces[0]._merging, []
    monkeypatch.setattr(ours, "_merging", lambda text: calls.append(text) or merging(text))
    some = [ours.ids[p] for p in sorted(ours.parts)[::200]]
    got = {(a, b): ours._compatible(a, b) for a in some for b in some}
    assert len(some) > 100 and len(calls) <= 2 * len(some)
    for (a, b), fits in got.items():
        pair = [ours.pieces[a], ours.pieces[b]]
        assert fits == ([*merging("".join(pair))][-1] == pair)
    assert len({*got.values()}) == 2


def test_segments_end_where_letters_end_and_stay_while_they_are_asked_for(pieces, monkeypatch):
    ours, library = pieces
    found = ours.segment.findall("▁one,▁two.\n\nthree_4²▁▁5é▁▁")
    assert found == ["▁one", ",", "▁two", ".\n\n", "three", "_4²", "▁▁5", "é", "▁▁"]
    calls = []
    monkeypatch.setattr(ours, "memo", piece_bpe._Memo(lambda text: calls.append(text) or ours._encode_segment(text)))
    monkeypatch.setattr(piece_bpe, "MEMO", 3)
    for i in range(40):
        text = f"again {chr(97 + i % 26) * (2 + i // 26)}, {'long' * 20}"
        assert ours.encode(text).tolist() == library.encode(text, add_eos=True)
    assert calls.count("▁again") == calls.count(",") == 1 and calls.count("▁" + "long" * 20) == 40
    assert len(calls) == 82 and len(ours.memo) + len(ours.memo.before) <= 12


def test_pieces_of_whole_documents(spark, pieces):
    _, library = pieces
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r for r in queries.QUERIES["op8_piece_encoding"](spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        ids = library.encode(r.text, add_eos=True)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids), digest, text)


def test_pieces_odd_rows(spark, pieces):
    found = piece_bpe.encode(docs_of(spark, ODD), public_tokenizers.path("piece_bpe_32k.model")).collect()
    for r in found:
        assert r.ids == pieces[1].encode(r.text or "", add_eos=True) and r.decoded == pieces[1].decode(r.ids)
    assert piece_bpe.encode(docs_of(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


# -- mixing -------------------------------------------------------------------------------------


def test_mixing_meets_target_shares(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = mixing.poisson_mix(docs, {"src0": 0.5, "src1": 0.5}).groupBy("source").sum("n_chars").collect()
    size = {r[0]: r[1] for r in got}
    assert set(size) == {"src0", "src1"} and 0.8 < size["src0"] / size["src1"] < 1.25
    total = docs.groupBy().sum("n_chars").first()[0]
    assert 0.9 < sum(size.values()) / total < 1.1


def test_mixing_draws_are_poisson(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 4 = 0, 'a', null) as source", "'xxxx' as text", "id as copy")
    mixed = mixing.poisson_mix(docs, {"a": 3.0, None: 1.0})  # rates 3 and 1/3
    n = mixed.groupBy("doc_id").count().join(docs, "doc_id").groupBy("source").agg({"count": "sum"}).collect()
    n = {r[0]: r[1] for r in n}
    assert 14_500 < n["a"] < 15_500 and 4_700 < n[None] < 5_300
    zero = docs.where("source = 'a'").join(mixed, "doc_id", "left_anti").count()
    assert abs(zero / 5000 - np.exp(-3)) < 0.012
    assert mixed.select("mix_key").distinct().count() == mixed.count()


def test_mixing_odd_rows(spark):
    docs = docs_of(spark, ODD)
    got = mixing.poisson_mix(docs, {"s0": 700.0, "s1": 1.0, "s2": 1.0})
    assert got.columns == [*docs.columns, "copy", "mix_key"] and got.count() > 0
    assert mixing.poisson_mix(docs_of(spark, [])).count() == 0
    twice = mixing.poisson_mix(docs).sort("mix_key").collect()
    assert twice == mixing.poisson_mix(docs.repartition(5)).sort("mix_key").collect()
