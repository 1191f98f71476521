"""pixelfold - Earth-observation time series as Spark DataFrames.

Every operator takes and returns DataFrames.  Rasters are long tables with one
row per (scene, x, y); series are long tables with one row per (pixel, date).
"""

__version__ = "0.1.0"
