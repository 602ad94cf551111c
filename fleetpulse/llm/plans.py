"""Queries of the operators in this folder, with their SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, counts, decontaminate, langid, minhash, mixing, pii, quality, repeats, sharding, tokenfiles, whitening
from .tables import table

SHARDS = 8
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(plan):
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return add


#: op4 in SQL: sets of shingles, one row per different set, links by shared shingles, and reachability.
NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) END AS shingles FROM w),
classes AS (SELECT min(doc_id) AS a, shingles, len(shingles) AS n FROM sets WHERE len(shingles) > 0 GROUP BY shingles),
members AS (SELECT doc_id, a FROM sets JOIN classes USING (shingles)),
single AS (SELECT a, n, unnest(shingles) AS shingle FROM classes),
pairs AS (SELECT x.a, y.a AS b, count(*) AS k, any_value(x.n + y.n) AS n FROM single x JOIN single y ON x.shingle = y.shingle AND x.a <> y.a GROUP BY x.a, y.a),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 75 * (n - k)),
reach AS (SELECT a, a AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id,
    coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN members m ON s.doc_id = m.doc_id LEFT JOIN least_of l ON m.a = l.a"""

_ESCAPED = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '</s>', '<\\/s>')"
#: op6 in SQL: turns in order, and the lengths of their escaped parts with the template's marks.
CHATS = f"""WITH r AS (SELECT conv_id, turn, role AS r0, text AS t0 FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, coalesce(r0, '') AS role, coalesce(t0, '') AS text FROM r),
c AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, t0 NULLS FIRST), '') AS loss,
    3 + sum(length('[INST][/INST]</s>') + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS chars FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(chars AS BIGINT) AS formatted_chars FROM c"""


def crc32_text(text):
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


@query()
def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.label_languages(docs, ["doc_id"]).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query()
def op3_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "items")


@query(NEAR_DUPLICATES)
def op4_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written, offsets = sharding.external_shuffle(docs, SHARDS)
    digests = written.select("doc_id", sharding.size_of(F.col("text")).alias("size"), crc32_text(F.col("text")).alias("text_crc32"),
                             F.lit("key").alias("law"), "shard", "bucket", "place",
                             sharding.shard_of(F.col("doc_id"), SHARDS + 1, 11).alias("grown_shard"))
    return sharding.slots(digests, offsets).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query(CHATS)
def op6_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema))
    out = chat.format_chats(chat.events_of(rows)).withColumn("turns", chat.read_back(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.under_loss(F.col("formatted"), F.col("loss_spans"))
    return out.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query()
def op7_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256",
                        F.size("passages").cast("long").alias("n_passages"), F.col("passage_words").alias("n_passage_words"))


@query()
def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, ["doc_id"])
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    lines = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count_of = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    counts_of = [count_of(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts_of, F.sha2(lines(F.col("base_spans")), 256).alias("base_sha256"), lines(F.col("spans")).alias("spans"))


@query()
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    placed, pieces = mixing.mix(docs)
    return mixing.taken_words(placed, pieces).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op10_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.quality_rules(docs, carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = tokenfiles.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
    return tokenfiles.read_documents(spark, folder).withColumnRenamed("key", "doc_id")


@query()
def op12_multiplicity_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error")


@query()
def op13_space_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = alignment.blocks_of(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.score_documents(blocks, alignment.link_counts(blocks)).withColumnRenamed("key", "doc_id")
