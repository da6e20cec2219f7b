"""Training-data operators (dedup, quality, PII, mixing, tokenising, media, URLs).

Nothing outside this subpackage imports it.  Its functions are pickled by
value, so executors need neither this package nor a shared code folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
