"""grantweave: access control as data, on Spark.

Rules, statements, grants, tags and masks are relations; every operator is a
DataFrame -> DataFrame function planned by Catalyst (see README.md).
"""

__version__ = "0.1.0"
