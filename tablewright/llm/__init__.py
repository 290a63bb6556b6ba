"""Operators for pipelines that prepare text for language-model training."""

import sys

from pyspark import cloudpickle

# Functions travel with their tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
