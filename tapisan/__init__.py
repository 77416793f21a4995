"""Tapisan: a PySpark-native engine for acquiring, curating and querying article collections."""
