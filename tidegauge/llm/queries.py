"""Every query of this subpackage and its oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from tidegauge.llm import alignment, bpe, collocation, decontamination, exact_dedup, language_id, near_dedup, quality, secret_scan, sharding, suffix_dedup, toxicity, url_filter  # noqa: F401  (each registers its queries)
from tidegauge.llm.common import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
