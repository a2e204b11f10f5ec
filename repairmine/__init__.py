"""repairmine: mine token-level repairs from text and event corpora on Spark.

Layout
  sources/    table readers, the derived submission view, result-table sinks
  functions/  Column-level helpers (cleaning, hashing, dictionaries, symbols)
  operators/  DataFrame operators (tokens, lines, distance, edit scripts,
              corruption, sampling, vocabularies)
  plans/      the registered queries (one per operator) and the mining jobs
  streaming/  Structured Streaming forms of the incremental jobs
"""

__all__ = ["get_spark"]

from repairmine.session import get_spark  # noqa: E402
