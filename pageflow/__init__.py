"""pageflow: a PySpark-native engine for page layout, dialogue and corpus data."""
