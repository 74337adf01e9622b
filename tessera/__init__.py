"""Point-in-time scoring analytics as composable Spark DataFrame operators."""
