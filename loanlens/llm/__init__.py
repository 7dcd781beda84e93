"""Operators for training-data pipelines (dedup, scoring, packing, search).

Nothing outside this package imports it; its queries are registered by
`loanlens.llm.queries`.
"""
