"""Training-data operators for large text, vector and chat tables.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; `queries` registers one query for
each of them.
"""
