"""ledgerline: sales analytics and forecasting as Spark DataFrame operators.

Every operator takes and returns a ``pyspark.sql.DataFrame``; the work runs as
Spark jobs (scans, joins, grouping, windows, grouped pandas maps) so it scales
with the cluster rather than with the driver.
"""

__version__ = "0.1.0"
