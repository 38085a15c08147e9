"""Document processing as Spark jobs: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the tasks that call them, so the
# package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
