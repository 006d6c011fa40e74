"""labspark: susceptibility-report analytics on PySpark DataFrames."""
