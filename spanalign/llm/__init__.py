"""Operators of a training-data pipeline: chat formatting, quality
resampling, lattice scoring, personal data, mixing, vector and SimHash
near-duplicates, fingerprints, packing and sharding.

Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get this subpackage's functions with the job and need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
