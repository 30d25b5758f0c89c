"""Vellum: document and procurement analytics expressed as Spark DataFrame plans."""
