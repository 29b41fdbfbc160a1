"""quillspark: content-collection analytics as PySpark DataFrame operators."""
