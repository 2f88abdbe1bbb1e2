"""quire: language-model data and evaluation tables as Spark jobs.

Registered queries live in ``quire.plans.registry`` (name -> fn(spark, sf_dir)),
their DuckDB twins in ``quire.plans.oracles``.
"""

import sys as _sys

try:  # Python functions shipped to executors (mapInPandas) travel by value, so the
    # workers need no copy of this package on their path.
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: workers import the package instead
    pass
