"""A PySpark-native engine for diversity, agreement and quality of text collections."""
