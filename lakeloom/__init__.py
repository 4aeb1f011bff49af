"""A Spark-native engine for ingesting, transforming, searching and analysing gathered data."""
