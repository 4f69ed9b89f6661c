"""The reports, one function each: DataFrames in, one DataFrame out."""
