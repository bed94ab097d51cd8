"""strataloom: header-driven tables and long-form marker analytics on Spark DataFrames."""
