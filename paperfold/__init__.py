"""Exam-corpus retrieval and evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship the package's Python functions inside the job: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
