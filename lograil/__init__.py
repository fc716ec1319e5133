"""lograil: log analytics on Spark DataFrames.

Functions of this package take and return DataFrames. Code that runs inside Python tasks is pickled by
value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
