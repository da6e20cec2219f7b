"""keystrata: a versioned key-value engine on Spark DataFrames.

An operation log (user_key, seq, type, value) is the only data structure; reads,
snapshots, compaction, value separation and recovery are plans over it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
