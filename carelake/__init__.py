"""carelake: a PySpark-native engine for adherence, vitals, stock, safety, catalogue and text data."""
