"""tracetide: event-trace analytics expressed as Spark DataFrame plans.

A trace is a DataFrame of time-ordered scheduler events
(idx, timestamp, cpu, pid, event, arg0, arg1).  The library derives
next/previous-event columns with windows, compiles category specs into
single-scan plans producing point or segment frames, searches event
patterns with as-of style windows, and summarises/rasterises the result.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python workers need no install or path setup: functions of this package
    (pandas UDFs, mapInPandas bodies) are pickled by value."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older pyspark: rely on the import path
        pass


_ship_by_value()
