"""gridloom: a Spark-native engine for gridded geospatial tables and time series."""
