"""tessella: a PySpark-native analytics engine."""
