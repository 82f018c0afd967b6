"""Card-fraud analytics on Spark: features, rule scoring, marts, drift, training."""
