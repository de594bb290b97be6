"""Operators of a training-data pipeline, built on Spark DataFrames.

The subpackage stands alone: nothing else in the library imports it, and it
imports nothing else of the library.
"""
