"""Training-data operators: classification, deduplication, packing, sharding, mixing, search.

Each operator is one module; ``registry`` lists their queries.  Nothing outside
this folder imports it except ``__spark_entry__`` (guarded) and
``corpus_pipeline``.
"""
