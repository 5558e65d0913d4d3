"""Streaming forms of the ledger operators; task functions are sent by value."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
