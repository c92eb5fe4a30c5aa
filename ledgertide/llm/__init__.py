"""Training-data operators: quality, duplicates, contamination, mixing and token output.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
