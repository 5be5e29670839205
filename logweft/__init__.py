"""Log analytics on Spark: text logs in, counted groups and reports out."""

import sys

from pyspark import cloudpickle

from logweft.functions.layout import DEFAULT_LAYOUT, Layout, UnsupportedLayoutError, compile_layout
from logweft.plans.analysis import (
    Analysis,
    AnalysisOptions,
    RunOptions,
    RunResult,
    analyze,
    detect_layout,
    iter_entries,
    merge,
    run,
)
from logweft.plans.store import Results, SavedAnalyses, merge_results
from logweft.staging import Staging

# Python workers receive the few functions they run; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Analysis",
    "AnalysisOptions",
    "DEFAULT_LAYOUT",
    "Layout",
    "Results",
    "RunOptions",
    "RunResult",
    "SavedAnalyses",
    "Staging",
    "UnsupportedLayoutError",
    "analyze",
    "compile_layout",
    "detect_layout",
    "iter_entries",
    "merge",
    "merge_results",
    "run",
]
