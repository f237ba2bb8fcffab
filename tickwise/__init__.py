"""tickwise: market-data analytics on PySpark.

Quotes, trades and price bars in; window aggregates, indices, drawdowns,
trend segments, dashboard series and feature tables out.  Every public
function takes DataFrames (or Columns) and returns them without running a job.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions run inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
