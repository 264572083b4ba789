"""A PySpark-native analytics engine for lecture-recording operations."""
