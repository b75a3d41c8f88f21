"""Queries and oracle SQL of the training-data operators."""

from . import conversation_repair, decontaminate, exact_dedup, language, line_dedup, near_dedup, packing, substring_dedup, token_counts, token_files, toxicity, vector_codes, warc

MODULES = (
    decontaminate, near_dedup, token_files, packing, warc, toxicity, exact_dedup, language, token_counts, line_dedup,
    conversation_repair, vector_codes, substring_dedup,
)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
