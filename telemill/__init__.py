"""Device-telemetry analytics, private synthesis and its evaluation, as Spark DataFrame operators."""
