"""barweave: equity-panel analytics expressed as Spark DataFrame operations.

Every operator takes and returns DataFrames (or maps Column to Column), keeps
long tables, and never pulls data to the driver.
"""

__version__ = "0.1.0"
