"""polderlake: layered (bronze, silver, gold) analytics as plain Spark jobs.

Every operator is a function from DataFrame to DataFrame; paths, clocks and
column names are arguments, so the same function serves batch and stream.
"""

__version__ = "0.1.0"
