"""A layout-analysis and text-processing engine on PySpark DataFrames."""
