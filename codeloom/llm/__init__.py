"""Operators for preparing language-model training data.

Functions of this package are shipped to executors by value, so a cluster needs
no installed copy of it (only the third-party libraries an operator names).
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
