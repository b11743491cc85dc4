"""Jobs and their building blocks. Functions that run in tasks travel with their task."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
