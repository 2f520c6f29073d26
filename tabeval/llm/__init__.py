"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; deleting it leaves the rest working.
One module per operator, ``queries`` registers one thin query for each.
"""

import sys

from pyspark import cloudpickle

# tasks get this code with the job: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
