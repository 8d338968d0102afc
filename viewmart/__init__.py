"""Subscriber analytics on Spark: bronze -> silver -> gold -> dashboard queries.

Every step is a DataFrame -> DataFrame function made of built-in expressions.
"""
