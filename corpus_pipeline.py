"""The corpus pipeline, whose stages are in :mod:`tributary.llm.pipeline`."""

from tributary.llm.pipeline import ORACLE_SQL, STAGES, encoded, mixed, near_dedup, private_data, quality_rules, run  # noqa: F401
