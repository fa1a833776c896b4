"""tableferry: move legacy tables into clean, typed targets with Spark.

The package reads tables, selects and renames columns, converts messy values
with a report of what failed, validates and coerces by database dialect,
translates column types, matches schemas, restructures tables and reconciles
what was loaded.  Every operator takes and returns DataFrames or Columns.
"""

__version__ = "0.1.0"
