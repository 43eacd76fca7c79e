"""The steps of a bagging run, each a function from DataFrames to DataFrames."""
