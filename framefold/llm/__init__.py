"""Training-data operators: language, near copies, repeats, packing, scoring, tokens and search.

Nothing outside this package imports it.
"""
