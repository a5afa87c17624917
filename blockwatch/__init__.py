"""blockwatch: log-block anomaly analytics as Spark DataFrame transforms.

Layout:
  sources/    readers, sinks, and the views over the driver tables
  functions/  Column -> Column scalar expressions (parsing, time, lists, text)
  operators/  DataFrame -> DataFrame operators (position, blocks, templates,
              sampling, features, neighbours, pseudo labels, keywords, rules,
              fusion, evaluation)
  plans/      end-to-end detectors and the query registry
  streaming/  Structured Streaming forms of ingest, windowed blocks and scoring
"""

__version__ = "0.1.0"
