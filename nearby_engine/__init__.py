"""Location-based company and hiring analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the executors inside the task, so the package needs no
# installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
