"""tidegrid: sparse, chunked raster time-series cubes as Spark DataFrames."""
