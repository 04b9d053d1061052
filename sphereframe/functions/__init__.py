"""Column-level building blocks: everything here maps Columns to Columns or DataFrames to DataFrames."""
