"""A PySpark-native engine for declarative analytical requests."""
