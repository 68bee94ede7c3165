"""Match, fixture and event analytics expressed as Spark DataFrame operators."""
