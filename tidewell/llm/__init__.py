"""Operators for large-scale training-data pipelines.

Everything here stands on its own: the rest of the library never imports this
subpackage.  ``queries`` registers the thin ``opN_<name>`` queries.
"""
