"""Training-data operators: thirteen corpus components built on Spark.

Nothing else in the library imports this subpackage.
"""
