"""valuelens: customer-value snapshots, scoring, decisions and evaluation on Spark.

Sub-packages
------------
sources    readers for the supplied tables, raw multi-source loads, sinks
functions  column-expression helpers (JVM-side, codegen friendly)
operators  DataFrame operators: contract/quality, as-of snapshots, ranking,
           evaluation, conformal intervals, policy, models
plans      end-to-end jobs and the query registry used by ``__spark_entry__``
streaming  incremental (file-stream) variant of the transaction contract
"""

__all__ = ["session"]
