"""Queries of this package over the given tables, by name, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from keysift.llm import (
    alignment, decontaminate, digest, knn, langid, linededup, mixing, pieces, pii, pitmanyor,
    simhash, warc, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_pieces": pieces.op3_pieces,
    "op4_language_model": pitmanyor.op4_language_model,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_personal_data": pii.op6_personal_data,
    "op7_simhash_near_duplicates": simhash.op7_simhash_near_duplicates,
    "op8_language_id": langid.op8_language_id,
    "op9_exact_top_k": knn.op9_exact_top_k,
    "op10_document_fingerprints": digest.op10_document_fingerprints,
    "op11_decontamination": decontaminate.op11_decontamination,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_whitening": whitening.op13_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op2_mix_sources": mixing.SQL,
    "op9_exact_top_k": knn.SQL,
    "op11_decontamination": decontaminate.SQL,
}
