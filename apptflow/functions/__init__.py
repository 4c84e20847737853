"""Column-expression builders (all JVM-side, no Python UDFs)."""
from apptflow.functions.draws import u, pick, weighted_pick, cumulative_bounds  # noqa: F401
from apptflow.functions.flags import *  # noqa: F401,F403
