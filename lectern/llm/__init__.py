"""Training-data operators: ten corpus-scale stages built on DataFrames.

Nothing outside this subpackage imports it.
"""
