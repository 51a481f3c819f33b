"""Operators for preparing language-model training data.

Functions that run on Python workers are shipped by value, so that a worker
needs none of this package on its own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
