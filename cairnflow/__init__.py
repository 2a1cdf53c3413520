"""Community posts to ranked, evidence-backed problem clusters, as Spark DataFrame operators.

Kernels are pickled by value: Python workers need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
