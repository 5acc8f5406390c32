"""From the syntax tree to DataFrames."""
