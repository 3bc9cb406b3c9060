"""A PySpark-native engine for evidence-backed offer data."""
