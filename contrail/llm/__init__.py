"""Operators for preparing training data: one module per operator.

The Python functions that run inside Spark tasks travel with the job, so executors need numpy, pandas and pyarrow but
no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
