"""Reusable DataFrame operators."""

from viewmart.operators.dedup import keep_first
from viewmart.operators.frequency import histogram, most_common, value_counts
from viewmart.operators.global_stats import impute, with_globals
from viewmart.operators.guards import any_of, existing, has, unique_names, where_in
from viewmart.operators.lookup import attach_lookup
from viewmart.operators.page import bin_of, page
from viewmart.operators.quantiles import exact_quantiles, quantile_values
from viewmart.operators.spelling import spelling_clusters, with_class_names

__all__ = [
    "any_of", "attach_lookup", "bin_of", "exact_quantiles", "existing", "has", "histogram", "impute",
    "keep_first", "most_common", "page", "quantile_values", "spelling_clusters", "unique_names", "value_counts", "where_in", "with_class_names",
    "with_globals",
]
