"""Training-data operators: toxicity, near duplicates, decontamination, mixing,
licences, sharding, token counts, personal data, quality rules, language ID,
ranked search, fill-in-the-middle, byte-level BPE."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel whole, so executors need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
