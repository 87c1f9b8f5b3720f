"""marketweave: a Spark-native market-analytics engine."""
