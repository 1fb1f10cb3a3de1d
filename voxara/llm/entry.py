"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxara.llm import bpe, cdc, chat, conversation_repair, decontam, filter_audit, itq_links, lattice, mpegts, ngram_join, secrets, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_lattice": lattice.op1_lattice, "op2_warc": warc.op2_warc, "op3_cdc": cdc.op3_cdc, "op4_mpegts": mpegts.op4_mpegts, "op5_ngram_join": ngram_join.op5_ngram_join, "op6_toxicity": toxicity.op6_toxicity, "op7_decontam": decontam.op7_decontam, "op8_chat": chat.op8_chat, "op9_bpe": bpe.op9_bpe, "op10_secrets": secrets.op10_secrets, "op11_filter_audit": filter_audit.op11_filter_audit, "op12_conversation_repair": conversation_repair.op12_conversation_repair, "op13_itq_links": itq_links.op13_itq_links}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.sql(), "op8_chat": chat.SQL, "op11_filter_audit": filter_audit.SQL, "op13_itq_links": itq_links.SQL}
