"""Entity resolution and training-data preparation on PySpark DataFrames."""

__version__ = "0.1.0"
