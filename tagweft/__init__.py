"""HTML parsing, rewriting and text analytics on PySpark DataFrames."""
