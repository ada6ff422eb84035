"""pagesift — main-body extraction over web pages as Spark DataFrame operators.

Tables flow ``pages -> cleaned -> page_events -> nodes -> node_features ->
sequences -> scored -> bodies``; every step is a ``DataFrame -> DataFrame``
function built on Spark SQL expressions, with Arrow-batched pandas UDFs only
for the entity decoder and the per-page stack fold.
"""

import sys as _sys

from pagesift.config import Options

__all__ = ["Options"]


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so the UDFs reach Python workers
    that cannot import ``pagesift`` (other working directory, package not installed
    on the executors)."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle: workers import the package
        pass


_ship_by_value()
