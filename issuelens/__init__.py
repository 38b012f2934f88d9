"""issuelens: issue-tracker profiling, retrieval and evaluation on Spark DataFrames.

Every public function takes DataFrames (or a SparkSession and a path) and returns
DataFrames; nothing holds a global session.
"""

import sys as _sys

__version__ = "0.1.0"

# Python workers need not have this package installed: functions and classes of
# issuelens that travel inside a task (encoders, generators, block products)
# are pickled by value.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship the package with --py-files
    pass
