"""Card-transaction risk analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

from ledgerlens.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
