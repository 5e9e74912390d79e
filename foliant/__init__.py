"""foliant: long-document analytics on PySpark DataFrames."""
