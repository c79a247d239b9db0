"""Content catalogs on Spark."""

__version__ = "0.2.0"
