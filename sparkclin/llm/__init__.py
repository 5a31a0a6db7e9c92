"""Operators for preparing large text corpora as training data.

One module per operator; ``catalog`` registers their queries. Nothing else in the library imports this
subpackage. Modules that run inside tasks import only numpy / pyarrow helpers.
"""
