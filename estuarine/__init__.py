"""Community-ecology and environmental-DNA analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
