"""Operators for training corpora. Nothing else in the library imports this subpackage."""

from ordwell.llm import bpe_codec, decontaminate, language_id, line_dedup, merkle, periodic_runs, pii, quality, shards, simhash, token_counts, token_files, url_filter

MODULES = (simhash, quality, language_id, shards, token_counts, bpe_codec, decontaminate, url_filter, line_dedup, pii, token_files, merkle, periodic_runs)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
