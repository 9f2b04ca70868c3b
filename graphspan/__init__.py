"""graphspan: distances and diameters of large weighted graphs on Spark DataFrames."""
