"""tarmac - flight on-time analytics and delay models on Spark.

Sub-packages:

* ``sources``   scans, sinks and the test-data adapters (flights, prediction log)
* ``functions`` column expressions (bins, flags, lookups, derivation rules)
* ``operators`` DataFrame operators: cleaning, encoders, aggregates, metrics, drift
* ``plans``     multi-step jobs: feature transform, ETL, training, scoring
* ``streaming`` Structured Streaming scoring and log append
"""

__version__ = "0.1.0"
