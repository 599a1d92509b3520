"""A PySpark-native raster-to-vector analytics engine: images and gridded tables as DataFrames of pixels, masks, contours and layers."""
