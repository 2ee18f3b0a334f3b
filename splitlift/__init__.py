"""splitlift: A/B-test analytics for marketplace orders on Spark DataFrames.

Subpackages: ``sources`` (readers, sinks, table-derived inputs), ``functions``
(column expressions), ``operators`` (DataFrame -> DataFrame steps), ``plans``
(end-to-end runs, query catalog and SQL oracle), ``streaming`` (empty: the
analysed workload is batch only).
"""

__version__ = "0.1.0"
