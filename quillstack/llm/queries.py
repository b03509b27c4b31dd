"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .decontaminate import op6_decontamination
from .hard_negatives import op11_hard_negatives
from .langid import op5_language_id
from .minhash_join import op7_minhash_near_dedup
from .mixing import op13_source_mix
from .paragraph_dedup import op10_paragraph_dedup
from .secrets import op8_secret_scans
from .sentencepiece_nbest import op4_sentencepiece_nbest
from .source_audit import op12_source_audit
from .token_counts import op9_token_counts
from .topk import op3_exact_topk
from .url_filter import op1_url_filter
from .warc import op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_warc": op2_warc,
        "op3_exact_topk": op3_exact_topk,
        "op4_sentencepiece_nbest": op4_sentencepiece_nbest,
        "op5_language_id": op5_language_id,
        "op6_decontamination": op6_decontamination,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_secret_scans": op8_secret_scans,
        "op9_token_counts": op9_token_counts,
        "op10_paragraph_dedup": op10_paragraph_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_source_audit": op12_source_audit,
        "op13_source_mix": op13_source_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": sql.op2(),
        "op3_exact_topk": sql.op3(),
        "op6_decontamination": sql.op6(),
        "op7_minhash_near_dedup": sql.op7(),
        "op8_secret_scans": sql.op8(),
        "op11_hard_negatives": sql.op11(),
        "op12_source_audit": sql.op12(),
    }
