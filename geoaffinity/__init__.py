"""geoaffinity: location-aware recommendation analytics on PySpark.

Every public operator takes DataFrames and returns a DataFrame.
"""

import sys

from pyspark import cloudpickle

# Send the few numpy helpers to the Python workers with the task, so that the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
