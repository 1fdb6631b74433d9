"""PySpark-native payment-risk analytics: DataFrame, SQL and Structured Streaming operators."""
