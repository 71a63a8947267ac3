"""tidepool: live-topic analytics on Spark.

Topics (Kafka or file folders) are subscribed from the earliest message,
decoded with a pinned schema into an append-only history, and served as
counts, series and latest rows; models are built, evaluated, rebuilt and
used for scoring with pyspark.ml.  Packages:

- ``sources``: topic sources and the message publisher
- ``functions``: JSON schema inference, decoding, flattening, quarantine
- ``operators``: batch operators (ordered prefix, series, set and table
  operations, split, models, metrics, registry, as-of join)
- ``streaming``: ingest, live aggregates, scoring, incremental prefix,
  timed rebuild
- ``plans``: the registered queries with their SQL oracles
- ``workspace``: the dashboard flow as one API
"""

__version__ = "0.1.0"
