"""thermalis: a PySpark-native signal-to-outcome analytics library."""
