"""Planar greenery analytics on Spark DataFrames: exposure joins, ladder statistics, composites, panels and inference."""
