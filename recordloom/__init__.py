"""recordloom: record cleaning and entity resolution on Spark DataFrames."""

from recordloom.config import Settings

__all__ = ["Settings"]
