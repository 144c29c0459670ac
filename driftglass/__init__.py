"""driftglass: market time-series analytics written as Spark DataFrame plans."""
