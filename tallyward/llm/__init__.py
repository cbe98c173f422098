"""Operators for preparing training text at scale; nothing else in the library imports this package.

Functions that run in tasks are sent to the executors by value, so that the
package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
