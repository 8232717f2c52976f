"""The registered queries of the operators."""

from __future__ import annotations

from tablewright.llm import byte_bpe, embeddings, fill_in_middle, mixing, packing, perplexity, quality, repeats, secret_scan, simhash, spelling, toxicity, url_filter

MODULES = (mixing, simhash, packing, quality, toxicity, url_filter, secret_scan, perplexity, embeddings, repeats, byte_bpe, fill_in_middle, spelling)


def all_queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
