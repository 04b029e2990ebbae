"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signalmill.llm import bpe, langid, lexical, merkle, mixing, packing, pii, posting_lists, quality, secrets, simhash, token_planes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_pii": pii.op2_pii,
        "op3_langid": langid.op3_langid,
        "op4_secrets": secrets.op4_secrets,
        "op5_mixing": mixing.op5_mixing,
        "op6_simhash": simhash.op6_simhash,
        "op7_warc": warc.op7_warc,
        "op8_quality": quality.op8_quality,
        "op9_posting_lists": posting_lists.op9_posting_lists,
        "op10_token_planes": token_planes.op10_token_planes,
        "op11_lexical": lexical.op11_lexical,
        "op12_packing": packing.op12_packing,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": secrets.SQL, "op5_mixing": mixing.SQL, "op7_warc": warc.SQL, "op8_quality": quality.SQL, "op11_lexical": lexical.SQL, "op13_merkle": merkle.SQL}
