"""User-behaviour risk analytics as composable Spark DataFrame operators."""
