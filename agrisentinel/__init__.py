"""agrisentinel — food-risk early-warning analytics as Spark jobs.

Subpackages: ``sources`` (scans and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame transformations), ``plans`` (the
registered queries and their fixtures) and ``streaming`` (Structured
Streaming jobs).
"""

__version__ = "0.1.0"
