"""Column functions of the trace model, in one place."""

from tracewright.operators.clock import corrected
from tracewright.operators.links import remote_type
from tracewright.operators.report import colour_class, dist
from tracewright.operators.stats import dist_text, path
from tracewright.operators.variables import lookup
from tracewright.sources.tracelog import key_values, merge_vars, purge_empty, seconds_of_day

__all__ = ["colour_class", "corrected", "dist", "dist_text", "key_values", "lookup", "merge_vars", "path", "purge_empty", "remote_type", "seconds_of_day"]
