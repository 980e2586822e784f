"""Tree-ring analytics on Spark: ring widths, climate grids and site tables as DataFrames."""
