"""listflow: collect, clean, deduplicate, search and rank job listings with PySpark.

Everything is a function ``DataFrame -> DataFrame`` or ``Column -> Column``.
Column names and the reference time (``as_of``) are always parameters.
"""

__version__ = "0.1.0"
