"""Speech-and-text emotion analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames (or Columns) and holds no
session of its own.
"""

__version__ = "0.1.0"
