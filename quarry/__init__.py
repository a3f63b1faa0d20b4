"""quarry: passage retrieval and evaluation as Spark DataFrame jobs.

Every public operator takes DataFrames (and plain parameters) and returns a
DataFrame.  Nothing here collects data to the driver except where a side has
been counted and proven small (the question block of a search).
"""

__version__ = "0.1.0"
