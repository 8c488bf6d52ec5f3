"""Document-restoration analytics as PySpark DataFrames."""
