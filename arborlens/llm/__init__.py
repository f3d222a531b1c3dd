"""Training-data operators: fingerprints, filters, deduplication, archives and packing.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and column names and
returns a DataFrame; ``arborlens.llm.queries`` binds them to the test tables.
"""
