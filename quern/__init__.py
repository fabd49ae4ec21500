"""quern: a PySpark-native analytics engine for knowledge bases.

Every operator is a function from DataFrames to a DataFrame; nothing runs until the caller acts on the result.
"""
