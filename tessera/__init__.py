"""Point-cloud analytics on PySpark: points, grids, tiles, rasters, meshes and indexes as DataFrames."""
