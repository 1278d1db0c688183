"""tally — binary-classification data preparation and model evaluation on Spark DataFrames.

Sub-packages:
  sources    readers and writers (tables, image manifests, feature stores, result sinks)
  functions  column-expression helpers (safe division, sigmoid, softplus, seeded order keys)
  operators  DataFrame operators: cleaning, encoding, splits, profiling, metrics, thresholds,
             study pooling, histories, trial reports, models and search
  plans      fixture views over the driver tables and the registered query catalogue
  streaming  incremental (Structured Streaming) form of the evaluation counters
"""

__version__ = "0.1.0"
