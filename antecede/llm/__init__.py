"""Operators on text corpora: archives, duplicates, leaks, search, scans, classifiers and mixing."""

import sys

from pyspark import cloudpickle

# tasks carry this subpackage's functions with them, so executors need no copy of it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
