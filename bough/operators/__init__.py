"""The steps of an export, each from DataFrames to DataFrames."""
