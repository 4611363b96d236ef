"""Every query of this package."""

from starlens.llm import block_naming, chat_template, feistel_pii, filter_audit, hard_negatives, html_extract, minhash_bayes, mixing, packing, quality_rules, secret_scan, simhash_balls, suffix_dedup  # noqa: F401
from starlens.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
