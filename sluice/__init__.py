"""sluice: a Spark-native data loading and data-quality engine."""

# Functions that run in Python workers (mapInPandas header reads, foreachBatch
# helpers) are shipped by value, so executors need not have this package on
# their path.
try:  # pragma: no cover - depends on the PySpark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
