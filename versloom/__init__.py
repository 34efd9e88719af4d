"""versloom: text stylometry, resampling inference and text-collection operators on Spark DataFrames."""

__version__ = "0.1.0"
