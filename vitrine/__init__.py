"""Spark-native product discovery analytics.

Everything is a function from DataFrames to a DataFrame; nothing runs until the
caller acts on the result.  Functions that reach Python workers are pickled by
value, so executors need only PySpark and the installed libraries, not this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
