"""Training-data operators: packing, tokenizing, sharding, similarity, scoring, rules and deduplication.

Nothing outside this subpackage imports it; ``queries`` holds its registered queries and their SQL.
"""
