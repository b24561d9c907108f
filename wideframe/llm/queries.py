"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, chat_format, hamming_search, lang_id, mpeg, near_dedup, packing, secrets, sentencepiece_codec, sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_shard": sharding.op2_shard,
        "op3_lang_id": lang_id.op3_lang_id,
        "op4_lm_score": attention_lm.op4_lm_score,
        "op5_pack": packing.op5_pack,
        "op6_mpeg": mpeg.op6_mpeg,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
        "op10_hamming_search": hamming_search.op10_hamming_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": secrets.SQL, "op8_chat_format": chat_format.SQL, "op10_hamming_search": hamming_search.SQL}
