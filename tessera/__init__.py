"""tessera: a PySpark-native analytics and data-processing engine.

Every operator is a function over DataFrames.  Functions that run inside
Python workers are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
