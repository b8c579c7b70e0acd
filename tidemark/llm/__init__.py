"""Operators for training-data corpora, each a Spark job over DataFrames.

Nothing outside this subpackage imports it.  Its modules travel to executors
by value, so a cluster needs no copy of the package beside numpy and pyarrow.
"""

import sys

from pyspark import cloudpickle

from . import textkit, worker

for _module in (textkit, worker):
    cloudpickle.register_pickle_by_value(sys.modules[_module.__name__])


def ship(name: str) -> None:
    """Send the functions of the module `name` to executors by value."""
    cloudpickle.register_pickle_by_value(sys.modules[name])
