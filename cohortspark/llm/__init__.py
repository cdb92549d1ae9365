"""Training-data operators; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors receive these functions with the task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
