"""The corpus pipeline: toxicity filter, language filter, near-duplicate removal, packing.

Each stage's rows are written as Parquet and read again as the next one's documents. The stages are in
lexweave/llm/pipeline.py. No SQL can express them; tests compare them with brute-force versions.
"""

from __future__ import annotations

from lexweave.llm.pipeline import STAGES, run

ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
