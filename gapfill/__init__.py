"""Missing-data injection, filling and scoring on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors by value, so a session needs neither
# the package installed on the workers nor an extra file shipped.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from gapfill.operators.ampute import PatternConfig, introduce_missing  # noqa: E402
from gapfill.operators.impute.chained import MICEImputer, MissForestImputer, XGBoostImputer  # noqa: E402
from gapfill.operators.impute.completion import CompletionImputer  # noqa: E402
from gapfill.operators.impute.knn import KNNImputer  # noqa: E402
from gapfill.operators.impute.neural import DAEImputer, GAINImputer, VAEImputer  # noqa: E402
from gapfill.operators.impute.statistical import StatisticalImputer  # noqa: E402
from gapfill.plans.evaluate import EvaluationResults, evaluate  # noqa: E402

__all__ = ["PatternConfig", "introduce_missing", "StatisticalImputer", "KNNImputer", "MICEImputer", "MissForestImputer",
           "XGBoostImputer", "DAEImputer", "VAEImputer", "GAINImputer", "CompletionImputer", "EvaluationResults", "evaluate"]
