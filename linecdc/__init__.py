"""linecdc: line-level change data capture as Spark jobs."""

from __future__ import annotations

import sys

__version__ = "0.1.0"


def ship_by_value(module_name: str) -> None:
    """Pickle the functions of a module by value, so Python workers on a
    cluster run grouped-map / foreachBatch code without the package installed."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module_name])
