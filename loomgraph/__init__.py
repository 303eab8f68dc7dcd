"""Spark-native usage analytics: log evidence, joins, requests, contexts and processes as DataFrames."""
