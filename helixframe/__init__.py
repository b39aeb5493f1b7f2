"""Spark-native k-mer analytics, sequence assembly and collection statistics.

Every operator takes DataFrames and returns DataFrames; scalars reach the
driver only where their size is bounded by a parameter (a count spectrum, a
loop's termination count, a fixed-size sketch).
"""

__version__ = "0.1.0"
