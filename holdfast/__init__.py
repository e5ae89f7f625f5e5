"""Customer-retention analytics expressed as Spark DataFrame operators."""
