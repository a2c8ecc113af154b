"""DataFrame and Structured Streaming operators for Earth-observation question-answering data."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in executors travel with their task, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
