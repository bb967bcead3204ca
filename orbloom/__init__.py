"""orbloom: Spark-native analytics for time series of spherical-harmonic coefficient sets."""

__version__ = "0.1.0"
