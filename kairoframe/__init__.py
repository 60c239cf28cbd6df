"""Point-in-time analytics on PySpark.

Functions that run on executors are pickled by value, so a cluster's workers
need Spark and numpy, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
