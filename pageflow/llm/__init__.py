"""Corpus operators for language-model training data; nothing else in the package imports this."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this subpackage travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
