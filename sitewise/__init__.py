"""sitewise: site-suitability analytics as Spark DataFrame operators."""

from __future__ import annotations

import sys


def _pickle_by_value() -> None:
    """Ship this package's code inside task closures.

    Python functions that run on executors (``mapInPandas`` / ``applyInPandas``
    bodies) are pickled together with the package code they use, so workers
    need no installed copy of the package and no particular working folder.
    """
    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle without the API
        pass


_pickle_by_value()
