"""starlens — review analytics expressed as Spark DataFrame / SQL / MLlib / Structured Streaming jobs.

Layout:
  sources/    schemas, readers, sinks and the fixture views built from the driver tables
  functions/  Column -> Column helpers (text cleaning, word counts, buckets, time weights)
  operators/  DataFrame -> DataFrame operators (roll-ups, sampling, vocabulary, sentiment, charts, models)
  streaming/  resumable file ingestion and scoring with Structured Streaming
  plans/      the registered queries and their SQL oracles
"""

__all__ = ["session"]
