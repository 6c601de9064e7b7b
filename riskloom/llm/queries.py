"""The registered queries of the operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    exact, jaccard, language, merkle, mixing, neighbours, packing, pages, quality, secrets, shards, trie, warc,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            CHECKS[function.__name__] = sql
        return function
    return add


# Unsigned CRC-32 of an ASCII text, bit by bit.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split({0}, ''), lambda s: ascii(s)::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))))"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("""
with t as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
    as text_sha256 from documents
), g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
""")
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its group of equal texts and whether it stays."""
    return exact.exact_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


@query()
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, from a model that saw no held-out label."""
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"))
    return quality.quality_scores(docs, model).select(
        "doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@query(r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5(coalesce(text, '')) as mark, row_number() over (partition by doc_id, source, coalesce(text, '')) as turn
  from documents
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as position
  from d group by source
), w as (
  select *, 3 * source_size as cap, ([5, 2, 1])[(position % 3 + 1)::int] as weight from s
), f as (
  select *, sum(cap) over o - cap as caps_before, sum(weight) over o - weight as weight_before,
    sum(source_size) over () as total, sum(weight) over () as whole
  from w window o as (order by cap / weight::double, position)
), g as (select *, cap * (whole - weight_before) <= weight * (total - caps_before) as is_full from f),
h as (
  select *, coalesce(sum(cap) filter (is_full) over (), 0) as caps,
    coalesce(sum(weight) filter (is_full) over (), 0) as weights from g
), t as (
  select source, source_size, case when is_full then cap::double
    else (weight * (total - caps))::double / greatest(1, whole - weights)::double end as target from h
), p as (
  select d.*, t.source_size, t.target, floor(t.target)::bigint as words, coalesce(sum(size) over (
    partition by d.source order by ('0x' || substr(md5('mix' || coalesce(doc_id::varchar, '') || ':' || mark || ':' || turn), 1, 8))::bigint,
    doc_id, size, mark, turn rows between unbounded preceding and 1 preceding), 0) as start
  from d join t on d.source is not distinct from t.source
)
select doc_id, size::bigint as size, source_size, target,
  (case when source_size = 0 then 0 else (words // source_size) * size
    + greatest(0, least(size, words - (words // source_size) * source_size - start)) end)::bigint as taken
from p
""")
def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that the mix to the target weights takes."""
    mix = mixing.mix_sources(table(spark, folder, "documents"))
    return mixing.words_taken(mix).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


@query()
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(table(spark, folder, "documents"))


@query()
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class of similar documents and its number of links."""
    return jaccard.similar_documents(table(spark, folder, "documents")).select(
        "doc_id", "class_id", "links", "linked_texts", "copies"
    )


@query()
def op5_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document; equal texts share a shard."""
    return shards.sharded(table(spark, folder, "documents")).select(
        F.col("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, from a filter that saw no held-out row."""
    docs = table(spark, folder, "documents")
    return language.languages(docs, language.fit_languages(docs)).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query()
def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query("""
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), w as (
  select *, max(page_id) over (partition by payload_digest) as last_id from p
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and last_id <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and last_id <> page_id then last_id end as refers_to
from w
""")
def op8_warc_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Every page, written to archives and read back through the index of captures."""
    given = table(spark, folder, "pages")
    archive = warc.write_archive(given)
    keys = given.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("capture"))
    return warc.read_archive(archive, keys).select(
        F.when(F.col("page") != "", F.col("page")).cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


@query()
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: the rules' findings and what the network adds."""
    return secrets.secrets(table(spark, folder, "documents"))


@query()
def op11_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page, from differences to the nearest page of its host."""
    return pages.main_texts(table(spark, folder, "pages"))


@query(r"""
with raw as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), turns as (
  select conv_id, md5(strlen(role)::varchar || ':' || role || text) as digest,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words,
    row_number() over (partition by conv_id order by turn nulls first, md5(strlen(role)::varchar || ':' || role || text)) as i
  from raw
), convs as (
  select conv_id, conv_id - conv_id % 20 as head, """ + CRC32.format("conv_id::varchar") + r""" % 4 as h
  from (select distinct conv_id from raw)
), plan as (
  select c.*, (select count(*) from turns t where t.conv_id = c.head and t.i <= c.h) as taken from convs c
), rebuilt as (
  select p.conv_id, t.i as depth, digest, words from plan p join turns t on t.conv_id = p.head and t.i <= p.h
  union all
  select p.conv_id, p.taken + t.i - p.h, digest, words from plan p join turns t on t.conv_id = p.conv_id and t.i > p.h
  union all
  select conv_id, 0, '', 0 from plan
), named as (
  select conv_id, depth, words, md5(string_agg(digest, '/') over w) as id, max(depth) over (partition by conv_id) as length
  from rebuilt window w as (partition by conv_id order by depth)
), linked as (
  select *, lag(id) over (partition by conv_id order by depth) as parent from named
), nodes as (
  select depth, id, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words, max(parent) as parent,
    string_agg(case when depth = length then conv_id end::varchar, ',' order by conv_id) as ends
  from linked group by depth, id
), counted as (
  select n.*, (select count(*) from nodes c where c.depth = n.depth + 1 and c.parent = n.id) as n_children from nodes n
), totals as (
  select a.depth, a.id, sum((n.n_children = 0)::int) as n_leaves, sum((n.n_convs - 1) * n.words) as saved_tokens
  from counted n join linked a on a.conv_id = n.conv_id and a.depth <= n.depth group by a.depth, a.id
)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, t.n_leaves::bigint as n_leaves,
  t.saved_tokens::bigint as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from counted n join totals t on t.depth = n.depth and t.id = n.id
left join nodes p on p.depth = n.depth - 1 and p.id = n.parent
""")
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return trie.conversation_trie(table(spark, folder, "conversations")).drop("a", "b")


def _field(name: str, value: str | None = None) -> str:
    said = value or f"{name}::varchar"
    return f"coalesce(strlen({said})::varchar || ':' || {said}, '-')"


_PLAIN = " || ".join(_field(c) for c in merkle.FIELDS)
_LOWERED = " || ".join(
    _field(c, f"translate(text, '{exact.UPPER}', '{exact.LOWER}')" if c == "text" else None) for c in merkle.FIELDS
)


@query(f"""
with recursive leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as r, row_number() over () as row
  from (
    select doc_id, lang, sha256({_PLAIN}) as leaf,
      case when doc_id is not null and {CRC32.format("coalesce(doc_id, 0)::varchar")} % 3 = 0 then sha256({_LOWERED}) else sha256({_PLAIN}) end as changed
    from documents
  )
), levels as (
  select lang, 0 as k, list(leaf order by r) as d from leaves group by lang
  union all
  select lang, k + 1, list_transform(range(0, len(d), 8), lambda i: sha256(array_to_string(d[i + 1:i + 8], '')))
  from levels where len(d) > 1
), subroots as (
  select lang, d[1] as subroot, row_number() over (order by lang nulls first) - 1 as place from levels where len(d) = 1
), tops as (
  select 0 as k, list(subroot order by place) as d from subroots
  union all
  select k + 1, list_transform(range(0, len(d), 8), lambda i: sha256(array_to_string(d[i + 1:i + 8], ''))) from tops where len(d) > 1
), climb as (
  select row, lang, r, 0 as k, '' as proof, changed as fold from leaves
  union all
  select c.row, c.lang, c.r // 8, c.k + 1,
    c.proof || array_to_string(d[c.r // 8 * 8 + 1:c.r], '') || array_to_string(d[c.r + 2:c.r // 8 * 8 + 8], ''),
    sha256(array_to_string(d[c.r // 8 * 8 + 1:c.r], '') || c.fold || array_to_string(d[c.r + 2:c.r // 8 * 8 + 8], ''))
  from climb c join levels v on v.lang is not distinct from c.lang and v.k = c.k and len(v.d) > 1
), reached as (
  select * from climb c where c.k = (select max(k) from levels v where v.lang is not distinct from c.lang)
), crown as (
  select c.row, s.place as r, 0 as k, c.proof, c.fold from reached c join subroots s on s.lang is not distinct from c.lang
  union all
  select c.row, c.r // 8, c.k + 1,
    c.proof || array_to_string(d[c.r // 8 * 8 + 1:c.r], '') || array_to_string(d[c.r + 2:c.r // 8 * 8 + 8], ''),
    sha256(array_to_string(d[c.r // 8 * 8 + 1:c.r], '') || c.fold || array_to_string(d[c.r + 2:c.r // 8 * 8 + 8], ''))
  from crown c join tops t on t.k = c.k and len(t.d) > 1
)
select l.doc_id, l.leaf, s.subroot, t.d[1] as root, sha256(c.proof) as proof_sha256, c.fold as folded_root, c.fold = t.d[1] as verified
from leaves l join crown c on c.row = l.row and c.k = (select max(k) from tops)
join subroots s on s.lang is not distinct from l.lang join tops t on len(t.d) = 1
""")
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its leaf, its proof and whether a tampered copy still folds to the root."""
    return merkle.merkle_manifest(table(spark, folder, "documents"))
