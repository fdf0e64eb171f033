"""Writers: CSV (plain, guarded, single file), JSON, partition upsert.

Sinks are the only operators that run Spark jobs.  Each write goes through
Spark's commit protocol, so a lost executor's tasks are re-run and no partial
files become visible.
"""
