"""spanalign: span/boundary alignment analytics on Spark DataFrames.

Modules:
  functions  column expressions (word class, offsets, cleaning)
  sources    corpus tables, code-file trees, report loaders, sinks
  operators  spans, tokens, offsets, boundary joins, scores, reports
  plans      named query plans used by the entry points and the bench
  streaming  Structured Streaming variants of the group statistics
"""

import sys

from pyspark import cloudpickle

# Executors get this package's Python functions with the job and need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
