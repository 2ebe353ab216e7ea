"""Operators of a training-data pipeline.  Nothing else in the package imports from here.

Operators keep column names that start with an underscore for themselves while they work; a result
column replaces an input column of its name.
"""
