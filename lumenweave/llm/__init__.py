"""Operators for training-data pipelines over text corpora.

Nothing outside this subpackage imports it; ``lumenweave.llm.queries`` lists
its registered queries and their SQL.
"""
