"""Contact-page analytics on Spark: page snapshots in, annotated addresses out.

Every job has the shape ``DataFrame -> DataFrame`` and composes with
``DataFrame.transform``. The package reads data the user already holds and
makes no network request.
"""

__version__ = "0.1.0"
