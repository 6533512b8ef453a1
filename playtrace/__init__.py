"""Session-telemetry features, labels, metrics and classifiers as Spark DataFrame operators."""
