"""helixmill: a Spark-native engine for molecular-measurement and clinical tables."""

import sys

from pyspark import cloudpickle

# what runs in Python workers is sent along whole, since the workers' machines need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
