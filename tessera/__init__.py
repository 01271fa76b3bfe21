"""tessera: analyst operators on stock PySpark.

Every public function maps DataFrames to a DataFrame and is written with the
DataFrame API, so Catalyst plans it and the work runs on the executors.
"""

import sys

from pyspark import cloudpickle

# Python functions of this package that run on executors (pandas UDFs, the
# per-group and stateful functions) are pickled by value, so executors need
# no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tessera.session import get_session, scratch_path  # noqa: E402

__all__ = ["get_session", "scratch_path"]
