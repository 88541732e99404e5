"""tillcast: Spark-native retail revenue analytics and forecasting.

Every operator takes and returns a ``pyspark.sql.DataFrame`` keyed by
(store, date), so it composes with ``DataFrame.transform`` and leaves the
physical plan to Catalyst.
"""

__version__ = "0.1.0"
