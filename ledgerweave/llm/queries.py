"""The queries of this package over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import chat, language, mixing, radix_dedup, simhash, token_orc, toxicity, viterbi_pieces, vptree, warc


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; LEDGERWEAVE_TOKENIZERS names another folder."""
    folder = os.environ.get("LEDGERWEAVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    return chat.chat_digests(own.unionByName(spark.createDataFrame(hard, "conv_id long, turn long, role string, text string")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest_vectors(_table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_pieces.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_digests(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_pages(spark, _table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


ORACLE = {
    "op1_chat_formatting": """
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        f AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS last,
                     CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
                     CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 16 WHEN 'assistant' THEN 12 ELSE 9 + 6 + 4 + length(regexp_replace(role, '(\\\\|\\[/INST\\]|<</SYS>>|\\[INST\\]|\\[NAME\\]|\\[ROLE\\]|<<SYS>>|\\[ANS\\]|</s>|<s>)', 'x\\1', 'g')) END
                     + length(regexp_replace(text, '(\\\\|<s>\\[INST\\]|<s>\\[ROLE\\]|<s>\\[ANS\\]|<</SYS>>|\\[/INST\\]|<<SYS>>|\\[INST\\]|\\[NAME\\]|\\[ROLE\\]|\\[ANS\\]|</s>|<s>)', 'x\\1', 'g')) AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
               count_if(NOT ((last = '' AND role IN ('system', 'user')) OR (last IN ('system', 'assistant') AND role = 'user') OR (last = 'user' AND role = 'assistant'))) AS turns_out_of_order
        FROM f GROUP BY conv_id""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        g AS (SELECT page_id, strlen(h) AS payload_bytes, d, min(page_id) OVER (PARTITION BY h) AS first FROM p),
        b AS (SELECT page_id, payload_bytes, first, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(d, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest FROM g)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b""",
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE
