"""The corpus pipeline as the driver calls it; the stages live in ``tessera.llm.pipeline``."""

from tessera.llm.pipeline import STAGES, run

#: The quality classifier, SimHash and the tokenizer can't be said in SQL; a brute-force test stands in for it.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
