"""Word-space and vector-symbolic analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that a cluster needs no
# installation of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
