"""Analytics on scored timelines with PySpark DataFrames."""
