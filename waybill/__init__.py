"""A PySpark-native engine for document-field extraction and its evaluation."""
