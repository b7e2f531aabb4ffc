"""The corpus pipeline: five stages over ``documents``, as ``tonegrid.llm.pipeline`` has them."""

from tonegrid.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, apply_quality_rules, drop_contaminated, drop_near_duplicates, drop_toxic, run, tokenize

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "apply_quality_rules", "drop_contaminated", "drop_near_duplicates", "drop_toxic", "run", "tokenize"]
