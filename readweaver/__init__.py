"""readweaver: sequence analytics on PySpark DataFrames."""
