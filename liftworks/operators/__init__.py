"""Campaign-measurement operators: DataFrames in, DataFrame out."""
