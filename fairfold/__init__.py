"""Fair comparison of machine-learning models as Spark jobs.

Everything a user asks is a query over DataFrames: profiles, protocols, folds, leakage evidence,
predictions, metrics, leaderboards, diagnostics.  Row-level work stays on the executors; only
numbers that are bounded by columns x folds x classes x contenders reach the driver.
"""

import sys

from pyspark import cloudpickle

from fairfold.spec import Constraint, Objective, Protocol, RefusedError, TaskSpec

__all__ = ["Constraint", "Objective", "Protocol", "RefusedError", "TaskSpec"]

# the few functions that run in Python workers travel with the job, so executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
