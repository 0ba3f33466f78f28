"""Operators for building training corpora.

Their functions travel to the executors with the tasks, so that the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
