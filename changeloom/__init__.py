"""Change-data processing on Spark: change logs, net changes, replica apply and data checks as DataFrames."""
