"""Weftline: retrieval, relationship and corpus analytics expressed as Spark DataFrame plans."""
