"""Plans: the warehouse's tables as builders from canonical record tables to DataFrames."""
