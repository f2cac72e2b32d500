"""ledgerlens: schema-aware business analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` built from the
DataFrame / SQL API, so Catalyst plans it and executors run it.
"""

__version__ = "0.1.0"
