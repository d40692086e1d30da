"""Grounded-statement analytics on Spark.

Every operator is a plain ``DataFrame(s) -> DataFrame`` function; every scalar
function is a ``Column -> Column`` expression.  See README.md for the layout.
"""
