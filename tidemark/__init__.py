"""tidemark: a Spark-native engine for SQL views over committed change logs.

Batch semantics are DataFrames planned by Catalyst; live semantics are signed deltas applied in
commit order by Structured Streaming.  Nothing in this package imports ``tidemark.llm``.
"""
