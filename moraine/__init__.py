"""Spark-native analytics for quality-gated rasters, time series and terrain."""
