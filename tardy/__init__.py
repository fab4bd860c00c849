"""tardy: punctuality analytics on Spark.

Clean a trip table, derive calendar / time-of-day / distance features,
compute group statistics and join them back, explore, train and score
delay models, and merge model answers in Structured Streaming.
Everything is expressed with the DataFrame, Spark SQL, MLlib and
Structured Streaming APIs.
"""

__version__ = "0.1.0"
