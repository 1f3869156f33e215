"""shoalgrid: gridded-observation analytics on PySpark (rasters as tables of cells, surveys as tables of points)."""
