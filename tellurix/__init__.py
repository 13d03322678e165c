"""tellurix: a PySpark-native engine for evaluation pipelines."""
