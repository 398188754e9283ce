"""barsmith: PySpark-native analytics for daily market bars."""
