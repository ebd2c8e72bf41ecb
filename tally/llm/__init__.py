"""Operators of a training-data pipeline over ``documents``.

Nothing else in the library imports this subpackage; ``__spark_entry__``
adds its queries only while it is present.
"""
