"""Operators for training-data pipelines over document and page tables.

Every operator takes DataFrames and returns DataFrames; the registered queries are in `llm/queries.py`."""
