"""Functions of the engine; every function maps DataFrames to DataFrames."""
