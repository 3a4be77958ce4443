"""Operators for preparing language-model training data.

Nothing else in graphloom imports this subpackage; removing it (with
``corpus_pipeline.py`` and ``tests/llm``) leaves the rest working.
"""

from pyspark import cloudpickle

import graphloom

# functions go to the executors whole, so that these need not have the package installed
cloudpickle.register_pickle_by_value(graphloom)
