"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage.  ``QUERIES`` and
``ORACLES`` in :mod:`relspark.llm.registry` are what the driver entry adds.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that a cluster need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
