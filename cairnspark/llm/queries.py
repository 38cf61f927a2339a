"""The numbered operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import ann, bwt, chat, conversation_sql, decontaminate, language, lines, pii, repair, rlz, sentencepiece_codec, simhash, toxicity, trie
from cairnspark.llm.shared import table


def piece_model() -> str:
    """The vocabulary file: $CAIRN_PIECE_MODEL, or the one of the installed public tokenizers."""
    if at := os.environ.get("CAIRN_PIECE_MODEL"):
        return at
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprint over four-word shingles and the component linked at 4 bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, near=4)
    digits = [F.hex(F.substring("fp", i, 1)) for i in range(8, 0, -1)]  # most significant byte first
    return found.select("doc_id", F.lower(F.concat(*digits)).alias("fingerprint"), "component_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; a null text counts as empty."""
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), piece_model())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_rlz": rlz.op1_rlz,
        "op2_simhash": op2_simhash,
        "op3_pii": pii.op3_pii,
        "op4_tiling": decontaminate.op4_tiling,
        "op5_language": language.op5_language,
        "op6_line_spread": lines.op6_line_spread,
        "op7_ann": ann.op7_ann,
        "op8_chat": chat.op8_chat,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_bwt": bwt.op10_bwt,
        "op11_repair": repair.op11_repair,
        "op12_trie": trie.op12_trie,
        "op13_toxicity": toxicity.op13_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_spread": lines.OP6_SQL, "op11_repair": conversation_sql.OP11_SQL, "op12_trie": conversation_sql.OP12_SQL}
