"""Training-data operators: license scans, packing, deduplication, scoring and search.

Every module keeps a general operator (a function on DataFrames) and a thin query
``opN_<name>(spark, sf_dir)`` that applies it to its whole table.  Nothing outside
this subpackage imports it, except ``corpus_pipeline.py`` and the guarded registry
in ``__spark_entry__.py``.
"""
