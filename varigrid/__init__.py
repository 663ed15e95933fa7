"""Multi-scale spatial analytics as composable ``DataFrame -> DataFrame`` operators."""
