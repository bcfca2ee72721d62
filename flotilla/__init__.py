"""flotilla: fleet planning and audit on Spark.

Subpackages: ``operators`` (planning, configuration, state and teardown,
logs), ``sources`` (table reads, derived inputs, JSON state and documents),
``functions`` (column expressions), ``streaming`` (log operators on
Structured Streaming) and ``plans`` (the registered queries and their SQL
oracles). Every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
