"""Part of driftglass, a Spark-native market analytics library."""
