"""routeloom: network and operations analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Pandas functions travel with their jobs, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .operators.network import Network  # noqa: E402

__all__ = ["Network"]
