"""bohagi: a PySpark-native engine for document, OCR and text-corpus analytics."""

__version__ = "0.1.0"
