"""staylens: lodging-reservation analytics on Spark DataFrames.

Sub-packages:
  sources/    schemas, readers, stand-in table builders, sinks
  functions/  reusable Column expressions (ratios, quantiles, text, vectors)
  operators/  DataFrame -> DataFrame operators (clean, filters, questions,
              metrics, top-k, vectors, changes, reports)
  plans/      the registered query catalog and its DuckDB oracle SQL
  streaming/  Structured Streaming change feed
"""

__all__ = ["session"]
