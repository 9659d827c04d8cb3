"""Operators of a training-data pipeline over documents, vectors and pages.

Nothing outside this package imports it; the query registry of the driver
contract (``__spark_entry__.py``) adds its keys only where it is present."""
