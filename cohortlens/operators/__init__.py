"""One module per statistic family; every function maps DataFrames to DataFrames."""
