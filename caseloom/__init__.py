"""caseloom: case-document triage, redaction and summaries as Spark jobs."""

import sys

from pyspark import cloudpickle

# The small Python helpers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
