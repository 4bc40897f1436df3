"""Operations of a large training-data pipeline; nothing else in the library imports these.

Functions that run in Python workers travel with the job, so executors need the
libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
