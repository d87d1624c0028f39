"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlens.llm import audit, mixing, quality, warc
from reviewlens.llm.bpe import op11_byte_bpe
from reviewlens.llm.chat import op8_chat_formatting
from reviewlens.llm.jaccard import op6_ngram_jaccard
from reviewlens.llm.licenses import op1_license_scan
from reviewlens.llm.packing import op9_best_fit_packing
from reviewlens.llm.pages import op5_main_text
from reviewlens.llm.secrets import op10_secret_scan
from reviewlens.llm.simhash import op4_simhash
from reviewlens.llm.whitening import op12_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_warc": warc.op2_warc,
    "warc_pushdown": warc.warc_pushdown,
    "op3_mixing": mixing.op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_main_text": op5_main_text,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_line_frequency": quality.op7_line_frequency,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "warc_pushdown": warc.PUSHDOWN_ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op7_line_frequency": quality.ORACLE,
    "op13_filter_audit": audit.ORACLE,
}
