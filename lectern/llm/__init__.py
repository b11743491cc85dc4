"""Operators for preparing training text: search, near copies, filters, extraction, scoring, mixing.

Functions that run in tasks travel with their task, so workers need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
