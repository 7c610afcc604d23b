"""Document analytics on Spark: chunking, hybrid search, sections, extraction, catalogue.

Every operator is a function from DataFrames (or Columns) to a DataFrame (or Column).
"""

import sys

from pyspark import cloudpickle

# Python helpers used inside tasks travel with the plan, so executors do not need
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
