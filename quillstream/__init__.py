"""Document analytics on Spark: typed blocks, units, terminology, checks, review queries."""

__version__ = "0.1.0"
