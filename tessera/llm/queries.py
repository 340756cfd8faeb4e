"""The queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm.bpe import op8_bpe
from tessera.llm.chat import OP1_SQL, op1_chat_formatting
from tessera.llm.decontaminate import op10_decontamination
from tessera.llm.fingerprints import op7_fingerprints
from tessera.llm.language import op3_language_id
from tessera.llm.merkle import OP11_SQL, op11_merkle_manifest
from tessera.llm.pipeline import run
from tessera.llm.quality import op6_quality
from tessera.llm.quality_rules import OP13_SQL, op13_quality_rules
from tessera.llm.simhash import op2_simhash
from tessera.llm.substrings import OP4_SQL, op4_substring_dedup
from tessera.llm.suffix_dedup import op5_suffix_dedup
from tessera.llm.url_filters import OP9_SQL, op9_url_filters
from tessera.llm.whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_simhash, op3_language_id, op4_substring_dedup, op5_suffix_dedup, op6_quality, op7_fingerprints, op8_bpe, op9_url_filters, op10_decontamination, op11_merkle_manifest, op12_whitening, op13_quality_rules)}
QUERIES["pipeline"] = lambda spark, sf_dir: run(spark, sf_dir)
SQL = {"op1_chat_formatting": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op9_url_filters": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op13_quality_rules": OP13_SQL}
