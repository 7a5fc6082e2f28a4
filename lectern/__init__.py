"""lectern: document and catalogue analytics expressed as PySpark DataFrame plans."""
