"""gleaner: incremental article and document analytics on Spark."""

import sys as _sys


def _ship_by_value() -> None:
    """Pickle this package's functions by value inside Python UDFs.

    The UDFs (HTML parsing, embeddings, top-k blocks) call into this package;
    pickled by value they run on workers where the package is not installed
    (the same effect as shipping it with ``--py-files``)."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: rely on --py-files
        pass


_ship_by_value()
