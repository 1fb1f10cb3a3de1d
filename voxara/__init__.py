"""voxara: raster analytics and training-data operators on PySpark."""
