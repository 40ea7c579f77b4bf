"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchloom.llm import chat, decontaminate, language, merkle, mixing, near_texts, near_vectors, pii, piece_bpe, repeats, secret_scan, topk, vector_codes
from patchloom.llm.common import count_kind, span_list, table
from patchloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    def keep(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return query(spark, sf_dir)

        QUERIES[query.__name__] = run
        if oracle is not None:
            ORACLES[query.__name__] = oracle
        return run

    return keep


@register(r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), laid as (
    select *, 4 + length(regexp_replace(role, '([\\:<#\n])', '\\\1', 'g')) + 2
        + length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) + 9 as size from turns
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
    cast(sum(size) as bigint) as formatted_chars
from laid group by conv_id
""")
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of conversation -7, read back from their formatted strings."""
    probe = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    formatted = chat.render(chat.fold_events(chat.log_of_turns(turns)))
    turn = F.struct("i", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), "learned")
    sizes = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"))
    read = chat.read_back(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: x["turn"]), "")
    learned = F.array_join(F.filter(F.transform("t", lambda x: x["learned"]), lambda x: x.isNotNull()), "")
    digests = read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
    )
    right = sizes.withColumnRenamed("conv_id", "_conv_id")
    return digests.join(right, digests["conv_id"].eqNullSafe(right["_conv_id"])).drop("_conv_id")


@register("""
with sizes as (
    select source, sum(coalesce(strlen(text), 0)) :: double as size, pow(sum(coalesce(strlen(text), 0)), 0.5) as weight
    from documents group by source
), rated as (
    select source, case when size > 0 then weight / sum(weight) over () * sum(size) over () / size else 1.0 end as rate
    from sizes
), terms as (
    select source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by source order by k) as c
    from rated, range(0, 200) t(k) where rate > 0
), drawn as (
    select d.doc_id, d.text, d.lang, d.source, d.n_chars,
        ('0x' || substr(md5('17:1:' || d.doc_id), 1, 13)) :: bigint / pow(2, 52) as u
    from documents d
), times as (
    select d.*, (select count(*) from terms t where t.source = d.source and t.c <= d.u) as times from drawn d
)
select doc_id, text, lang, source, n_chars, cast(copy as integer) as copy, md5('17:' || copy || ':' || doc_id || ':order') as mix_key
from times, range(1, 400) r(copy) where copy <= times
""")
def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, mixed with source shares in proportion to the root of their sizes."""
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


@register()
def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; ``n_live`` and ``n_copied`` say how ownership judges them."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = span_list("spans", secret_scan.KINDS, lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        *(count_kind("spans", i).alias(f"n_{k}") for i, k in enumerate(secret_scan.KINDS[:3])),
        F.sha2(base, 256).alias("base_sha256"),
        span_list("spans", secret_scan.KINDS).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )


@register()
def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = piece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    learned = language.learn(docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = language.predict(docs.select("doc_id", "text"), learned)
    return found.select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )


@register()
def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(count_kind("spans", i, lambda x: x["base"]).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)),
        F.sha2(span_list("spans", pii.KINDS, lambda x: x["base"]), 256).alias("base_sha256"),
        span_list("spans", pii.KINDS).alias("spans"),
    )


@register("""
with ok as (
    select vec_id, list_transform(embedding, lambda x: floor(x :: double * 64)) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score
    from ok q join ok c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), ranked as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
    from scored
)
select * from ranked where rank <= 20
""")
def op9_topk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantise(F.col("embedding")).alias("x"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


@register("""
with recursive ok as (
    select vec_id, list_transform(embedding, lambda v: v :: double) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0
    and len(list_filter(embedding, lambda v: v <> 0)) > 0
), links as materialized (
    select a.vec_id as u, b.vec_id as v from ok a join ok b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
    where list_cosine_similarity(a.x, b.x) >= 0.95
), reach as (
    select vec_id as node, vec_id as seen from embeddings
    union
    select r.node, l.v from reach r join links l on l.u = r.seen
), parts as (
    select node, min(seen) as component_id from reach group by node
)
select e.vec_id, (select count(*) from links l where l.u = e.vec_id) as n_links, p.component_id,
    e.vec_id = p.component_id as kept
from embeddings e join parts p on p.node = e.vec_id
""")
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and representatives of all vectors at cosine 0.95."""
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@register("""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(lower_ascii, '[ \\x09-\\x0D]+'), lambda w: w <> '') as w
    from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)
), sets as materialized (
    select doc_id, case when len(w) = 0 then [] when len(w) < 2 then [w[1]]
        else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
    from words
), items as materialized (
    select doc_id, len(s) as n, unnest(s) as item from sets
), counted as (
    select a.doc_id as u, b.doc_id as v, a.n as n, b.n as m, count(*) as c
    from items a join items b on a.item = b.item and a.doc_id < b.doc_id
    where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    group by all
), links as materialized (
    select u, v from counted where 100 * c >= 80 * (n + m - c)
    union all select v, u from counted where 100 * c >= 80 * (n + m - c)
), reach as (
    select doc_id as node, doc_id as seen from documents
    union
    select r.node, l.v from reach r join links l on l.u = r.seen
), parts as (
    select node, min(seen) as component_id from reach group by node
)
select s.doc_id, len(s.s) as n_shingles, p.component_id, s.doc_id = p.component_id as kept
from sets s join parts p on p.node = s.doc_id
""")
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents on two-word shingles."""
    return near_texts.near_texts(table(spark, sf_dir, "documents"), size=2)


@register("""
with words as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '') as w from documents
), windows as materialized (
    select doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) as h
    from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from words where len(w) >= 35)
), again as (
    select h from windows group by h having count(*) > 1
), gone as (
    select distinct doc_id, i + j as p from windows join again using (h), range(0, 35) t(j)
), placed as (
    select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words
)
select d.doc_id, len(d.w) as n_words, len(d.w) - count(p.word) filter (g.p is null) as n_removed,
    sha256(coalesce(string_agg(p.word, ' ' order by p.p) filter (g.p is null), '')) as kept_sha256
from words d left join placed p on p.doc_id = d.doc_id left join gone g on g.doc_id = p.doc_id and g.p = p.p
group by d.doc_id, d.w
""")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words that a repeated window of 35 words covers."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), size=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("""
with recursive ops as (
    select doc_id, list_reduce(list_prepend(4294967295 :: bigint,
        flatten(list_transform(string_split(doc_id :: varchar, ''), lambda c: [ord(c) :: bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, o: case when o >= 0 then xor(c, o) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select distinct doc_id from documents where doc_id is not null)
), texts as (
    select d.*, case when xor(o.c, 4294967295) % 3 = 0
        then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as changed
    from documents d left join ops o on o.doc_id = d.doc_id
), leaves as materialized (
    select doc_id, lang, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as r,
        count(*) over (partition by lang) as n, leaf, altered
    from (
        select doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
            sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) as altered
        from (
            select *, coalesce(strlen(doc_id :: varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars :: varchar) || ':' || n_chars, '-') as head
            from texts
        )
    )
), own as materialized (
    select 0 as level, lang, r, leaf as node, n from leaves
    union all
    select level + 1, lang, r // 8, sha256(string_agg(node, '' order by r)), (max(n) + 7) // 8
    from own where n > 1 group by level, lang, r // 8
), subroots as materialized (
    select lang, node, level, row_number() over (order by lang nulls first) - 1 as r, count(*) over () as n from own where n = 1
), upper_nodes as materialized (
    select 0 as level, r, node, n from subroots
    union all
    select level + 1, r // 8, sha256(string_agg(node, '' order by r)), (max(n) + 7) // 8
    from upper_nodes where n > 1 group by level, r // 8
), nodes as materialized (
    select s.r as tree, o.level, o.r, o.node from own o join subroots s on s.lang is not distinct from o.lang where o.n > 1
    union all
    select -1, level, r, node from upper_nodes where n > 1
), steps as materialized (
    select l.leaf, l.r as place, s.r as tree0, t.level + 1 as step, s.r as tree, t.level, l.r // cast(pow(8, t.level) as bigint) as r
    from leaves l join subroots s on s.lang is not distinct from l.lang, range(0, 30) t(level) where t.level < s.level
    union all
    select l.leaf, l.r, s.r, s.level + t.level + 1, -1, t.level, s.r // cast(pow(8, t.level) as bigint)
    from leaves l join subroots s on s.lang is not distinct from l.lang, range(0, 30) t(level)
    where t.level < (select max(level) from upper_nodes)
), runs as materialized (
    select p.tree0, p.place, p.step, coalesce(string_agg(n.node, '' order by n.r) filter (n.r < p.r), '') as before,
        coalesce(string_agg(n.node, '' order by n.r) filter (n.r > p.r), '') as after
    from steps p join nodes n on n.tree = p.tree and n.level = p.level and n.r // 8 = p.r // 8
    group by p.tree0, p.place, p.step
), folded as (
    select s.r as tree0, l.r as place, 0 as step, l.altered as node from leaves l join subroots s on s.lang is not distinct from l.lang
    union all
    select f.tree0, f.place, f.step + 1, sha256(x.before || f.node || x.after)
    from folded f join runs x on x.tree0 = f.tree0 and x.place = f.place and x.step = f.step + 1
), ends as (
    select tree0, place, arg_max(node, step) as folded_root from folded group by all
), proofs as (
    select tree0, place, sha256(string_agg(before || after, '' order by step)) as proof_sha256 from runs group by all
), top as (
    select node as root from upper_nodes where n = 1
)
select l.doc_id, l.leaf, s.node as subroot, t.root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root,
    e.folded_root = t.root as verified
from leaves l join subroots s on s.lang is not distinct from l.lang join ends e on e.tree0 = s.r and e.place = l.r
left join proofs p on p.tree0 = s.r and p.place = l.r, top t
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; every third one is folded with its text in lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    found = merkle.manifest(table(spark, sf_dir, "documents"), text)
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified"
    )


@register(r"""
with items as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as materialized (
    select distinct item_id :: varchar as item_id, n, array_to_string(w[i : i + n - 1], ' ') as c
    from (select *, unnest(range(1, len(w) - n + 2)) as i from (select *, least(len(w), 10) as n from items where len(w) > 0))
), words as materialized (
    select row_number() over () as row, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), spans as (
    select row, i, n, array_to_string(w[i : i + n - 1], ' ') as c
    from (select row, w, n, unnest(range(1, len(w) - n + 2)) as i from words, (select distinct n from windows) where len(w) >= n)
), hits as materialized (
    select row, i, n, item_id from spans join windows using (n, c)
), covered as (
    select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + n)) as p from hits) group by row
), named as (
    select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
    from (select distinct row, item_id from hits) group by row
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (row) left join named using (row)
""")
def op13_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of all documents is in the benchmark, by windows of ten words."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


_ROUND = """
), score{i} as (
    select q.row, q.part, c.entry, list_inner_product(c.e, c.e) - 2 * list_inner_product(q.x, c.e) as d
    from pieces q join book{j} c on c.part = q.part
), owner{i} as materialized (
    select row, part, arg_min(entry, struct_pack(d := d, entry := entry)) as entry from score{i} group by row, part
), means{i} as (
    select part, entry, list(m order by p) as e from (
        select part, entry, p, floor(sum(v) / count(*)) as m from (
            select o.part, o.entry, unnest(q.x) as v, unnest(range(len(q.x))) as p
            from owner{i} o join pieces q on q.row = o.row and q.part = o.part
        ) group by part, entry, p
    ) group by part, entry
), book{i} as materialized (
    select b.part, b.entry, coalesce(m.e, b.e) as e from book{j} b left join means{i} m on m.part = b.part and m.entry = b.entry
"""


@register("""
with ok as materialized (
    select row_number() over (order by vec_id) as row, vec_id, label, list_transform(embedding, lambda v: floor(v :: double * 1024)) as x
    from embeddings where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0
), pieces as materialized (
    select row, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] as x from ok, range(4) t(part)
), book0 as materialized (
    select part, row - 1 as entry, x as e from pieces where row <= 256
""" + "".join(_ROUND.format(i=i, j=i - 1) for i in range(1, 6)).rsplit("), means5", 1)[0] + """), coded as (
    select k.row, k.vec_id, k.label, string_agg(format('{:02x}', o.entry), '' order by o.part) as code,
        cast(sum(list_inner_product(q.x, q.x) - 2 * list_inner_product(q.x, b.e) + list_inner_product(b.e, b.e)) as bigint) as error
    from ok k join owner5 o on o.row = k.row join pieces q on q.row = o.row and q.part = o.part
    join book4 b on b.part = o.part and b.entry = o.entry group by k.row, k.vec_id, k.label
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
    (select sha256(string_agg(array_to_string(list_transform(e, lambda v: v :: bigint), ','), ',' order by part, entry)) from book4) as codebooks_sha256
from coded
""")
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in four parts of 256 entries, after four rounds."""
    x = vector_codes.quantise(F.col("embedding")).alias("x")
    coded, books = vector_codes.encode(table(spark, sf_dir, "embeddings").select("vec_id", "label", x))
    text = ",".join(str(v) for book in books for entry in book for v in entry)
    return vector_codes.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.sha2(F.lit(text), 256).alias("codebooks_sha256")
    )
