"""Operators that prepare text for language-model training; nothing outside this package imports them."""

import sys

from pyspark import cloudpickle

# Send this package along with the tasks, so that workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules["tagwright"])
