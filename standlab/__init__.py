"""Forest-inventory and species-mixture analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel with their code, so workers need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
