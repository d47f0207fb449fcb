"""Spark-native log, session and citation analytics.

Every operator maps DataFrames to DataFrames.  Subpackage ``llm`` holds the
operators for training data; nothing outside of it imports it.
"""
