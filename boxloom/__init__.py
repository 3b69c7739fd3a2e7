"""boxloom: a PySpark-native engine for bounding-box annotation data."""
