"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import (
    decontaminate, line_dedup, merkle, near_dedup, packing, quality_model, repeats, rules, sharding, simhash, token_counts,
    training_order, vector_codes,
)
from eventlens.llm.common import read

N_SHARDS = 24
PREDICT_AT = 0.3
VOCABULARIES = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def op1_mixture_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot; every shard holds the mixture of sources."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    return sharding.interleave(rows, N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fixed-stride token records in the order of training."""
    return training_order.in_training_order(read(spark, sf_dir, "documents"), f"{VOCABULARIES}/byte_bpe_50k.tiktoken")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 50-byte strings that also start in an earlier document."""
    cut = repeats.without_repeats(read(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document."""
    return token_counts.counted(read(spark, sf_dir, "documents"), f"{VOCABULARIES}/piece_bpe_32k.model")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over links of similar two-word shingle sets."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality score of every document, learned outside fold 0."""
    docs = read(spark, sf_dir, "documents")
    model = quality_model.fit(docs, read(spark, sf_dir, "labels"))
    return quality_model.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", (quality_model.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"),
    )


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document's pieces in sequences of 4096 tokens."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), f"{VOCABULARIES}/word_bpe_49k.json", with_ids=True)
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op8_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in ten documents or more."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.without_lines(docs, min_docs=10, keep_first=False)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
with split as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), lines as (
  select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from split
), keyed as (
  select *, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), frequent as (
  select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10
), marked as (
  select keyed.*, keyed.k in (select k from frequent) as gone from keyed
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op9_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every document and the verdict of the certified cutoffs of its language."""
    verdicts = rules.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def op10_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item whose template and slots fit."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the manifest of all documents, checked against rows of which some were changed."""
    docs = read(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    other = merkle.leaf(changed if c == "n_chars" else F.col(c) for c in merkle.LEAF_COLUMNS)
    proven = merkle.manifest(docs, changed=other).prove()
    root = merkle.folded(F.col("changed"), F.col("path"))
    return proven.select(
        F.col("key").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"), (root == F.col("root")).alias("verified"),
    )


OP11_SQL = r"""
with recursive rows as (
  select *, cast(doc_id as varchar) as name from documents
), sums as (
  select *, list_reduce(
    list_concat([4294967295::bigint], list_transform(range(length(name)), lambda i: ascii(name[i + 1])::bigint)),
    lambda c, b: list_reduce(
      list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))) as crc
  from rows
), framed as (
  select doc_id, lang, n_chars, xor(crc, 4294967295::bigint) % 7 = 0 as hit,
    coalesce(strlen(name) || ':' || name, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail
  from sums
), leaves as (
  select doc_id, coalesce('=' || lang, '') as tree,
    sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    sha256(head || coalesce(strlen((n_chars + hit::int)::varchar) || ':' || (n_chars + hit::int), '-') || tail) as other
  from framed
), placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx,
    count(*) over (partition by tree) as n
  from leaves
), nodes as (
  select tree, 0 as level, idx, n, leaf as h from placed
  union all
  select tree, any_value(level) + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' order by idx))
  from nodes where n > 1 group by tree, idx // 2
), subroots as (
  select tree, h as subroot, row_number() over (order by tree) - 1 as place, count(*) over () as trees from nodes where n = 1
), tops as (
  select 0 as level, place as idx, trees as n, subroot as h from subroots
  union all
  select any_value(level) + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' order by idx))
  from tops where n > 1 group by idx // 2
), ways as (
  select doc_id, tree, leaf, idx, 0 as level, other as h, '' as proof from placed
  union all
  select w.doc_id, w.tree, w.leaf, w.idx // 2, w.level + 1,
    case when s.h is null then sha256(w.h) when w.idx % 2 = 0 then sha256(w.h || s.h) else sha256(s.h || w.h) end,
    w.proof || coalesce(s.h, '')
  from ways w
  join nodes me on me.tree = w.tree and me.level = w.level and me.idx = w.idx and me.n > 1
  left join nodes s on s.tree = w.tree and s.level = w.level and s.idx = xor(w.idx, 1)
), ended as (
  select w.* from ways w join nodes me on me.tree = w.tree and me.level = w.level and me.idx = w.idx and me.n = 1
), beyond as (
  select e.doc_id, e.leaf, r.subroot, r.place as idx, 0 as level, e.h, e.proof from ended e join subroots r on r.tree = e.tree
  union all
  select w.doc_id, w.leaf, w.subroot, w.idx // 2, w.level + 1,
    case when s.h is null then sha256(w.h) when w.idx % 2 = 0 then sha256(w.h || s.h) else sha256(s.h || w.h) end,
    w.proof || coalesce(s.h, '')
  from beyond w
  join tops me on me.level = w.level and me.idx = w.idx and me.n > 1
  left join tops s on s.level = w.level and s.idx = xor(w.idx, 1)
)
select w.doc_id, w.leaf, w.subroot, me.h as root, sha256(w.proof) as proof_sha256, w.h as folded_root, w.h = me.h as verified
from beyond w join tops me on me.level = w.level and me.idx = w.idx and me.n = 1
"""


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the component of documents with near fingerprints."""
    found = simhash.simhash_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, by codebooks learned from all of them."""
    codes, books = vector_codes.vector_codes(read(spark, sf_dir, "embeddings"))
    listed = ",".join(str(x) for x in books.ravel().tolist())
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.select("vec_id", code.alias("code"), "error", "label_error", F.sha2(F.lit(listed), 256).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """The rounds written out: parts against entries, nearest, floored means."""
    rounds = vector_codes.ROUNDS
    steps = [
        f"""book0 as (select part, entry, place, x from (
  select p.part, p.place, p.x, dense_rank() over (order by p.vec_id) - 1 as entry from pieces p) where entry < {vector_codes.ENTRIES})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""far{r} as (select p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) as d
  from pieces p join book{r} b on b.part = p.part and b.place = p.place group by all),
near{r} as (select vec_id, part, entry, d from (
  select *, row_number() over (partition by vec_id, part order by d, entry) as turn from far{r}) where turn = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""mean{r} as (select p.part, n.entry, p.place, sum(p.x) as s, count(*) as c
  from pieces p join near{r} n on n.vec_id = p.vec_id and n.part = p.part group by all),
book{r + 1} as (select b.part, b.entry, b.place, cast(coalesce((m.s - ((m.s % m.c) + m.c) % m.c) // m.c, b.x) as bigint) as x
  from book{r} b left join mean{r} m on m.part = b.part and m.entry = b.entry and m.place = b.place)"""
            )
    head = f"""with kept as (
  select vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), spread as (
  select vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as i, len(embedding) // {vector_codes.PARTS} as width from kept
), pieces as (
  select vec_id, i // width as part, i % width as place, cast(floor(x::double * {vector_codes.SCALE}) as bigint) as x from spread
)"""
    tail = f"""totals as (
  select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from near{rounds} group by vec_id
), digest as (
  select sha256(string_agg(x::varchar, ',' order by part, entry, place)) as codebooks_sha256 from book{rounds}
)
select k.vec_id, t.code, t.error, (sum(t.error) over (partition by k.label))::bigint as label_error, g.codebooks_sha256
from kept k join totals t on t.vec_id = k.vec_id cross join digest g"""
    return ",\n".join([head, *steps, tail])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixture_shards, op2_training_order, op3_repeated_passages, op4_unigram_counts, op5_near_duplicates, op6_quality_scores, op7_pattern_packing,
        op8_repeated_lines, op9_controlled_rules, op10_benchmark_templates, op11_merkle_manifest, op12_simhash_groups, op13_vector_codes,
    )
}
SQL: dict[str, str] = {"op8_repeated_lines": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op13_vector_codes": _codes_sql()}
