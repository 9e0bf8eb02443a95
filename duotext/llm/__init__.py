"""Operators for building training corpora.  Nothing else in the package imports this one.

Every operator takes a DataFrame, reads the columns it names (``doc_id`` and ``text``
unless told otherwise), ignores all others (so their names can't clash) and returns
one row per input row unless it says otherwise.  A NULL text counts as empty.
"""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with the query, which therefore need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
