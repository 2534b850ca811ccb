"""Construction-finance analytics expressed as Spark DataFrame transformations."""
