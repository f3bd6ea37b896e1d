"""Lake profiling, data-quality and reporting operators on PySpark DataFrames."""
