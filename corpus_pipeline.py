"""The corpus pipeline: ``STAGES``, ``run`` and ``ORACLE_SQL`` of ``marketloom.llm.pipeline``."""

from marketloom.llm.pipeline import ORACLE_SQL, STAGES, keep_good, keep_one_of_near_copies, keep_uncontaminated, mix, run, shard

__all__ = ["ORACLE_SQL", "STAGES", "keep_good", "keep_one_of_near_copies", "keep_uncontaminated", "mix", "run", "shard"]
