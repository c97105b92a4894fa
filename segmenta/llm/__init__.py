"""Operators for building training data from a corpus of documents.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames, reads only the columns it
names, and keeps to these conventions unless its docstring says otherwise: a NULL text counts as empty; columns it does
not name are ignored (or passed through untouched where rows are passed through); rows that repeat another row entirely
are one document in operators that group, and separate rows in operators that work row by row; an empty table gives an
empty result.
"""

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
