"""Operators for building training data.

Nothing outside this package imports it. Its functions travel to the executors by value, and so does what
``lm`` broadcasts. Objects that ``language`` broadcasts do not, so that job needs the package there too.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
