"""Feature, drift, training and service-level jobs for ML operations, as Spark DataFrame plans."""
