"""Part of quarry, a PySpark engine for document collections and citation graphs."""
