"""footfall: who is likely to shop a retail event, worked out on Spark DataFrames.

Sub-packages
------------
sources    table scans, delimited files, model files, materialised tables
functions  column expressions (fiscal dates, guarded ratios, hash ordering)
operators  DataFrame in, DataFrame out: calendar, population, features, sampling, models
plans      the end-to-end pipeline and the catalogue of registered queries
"""

__version__ = "0.1.0"
