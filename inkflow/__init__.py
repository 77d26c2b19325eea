"""inkflow: documents in many formats as flat tables, and operators on them, on PySpark."""
