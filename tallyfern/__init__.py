"""Customer-analytics operators on Spark DataFrames.

Every operator takes and returns DataFrames or Columns; nothing holds a global
session and every constant is a parameter.
"""

__version__ = "0.1.0"
