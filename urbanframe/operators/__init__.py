from urbanframe.operators.aggregate import argmin, count_at_least, keyed_sums, reproducible_avg, share_of_total
from urbanframe.operators.joins import (
    JOIN_STRATEGIES,
    checked_broadcast,
    cross_join_count,
    equi_join,
    heavy_key_join,
    heavy_keys,
    measured_bytes,
    with_strategy,
)
from urbanframe.operators.nested import explode_array, flatten_struct, json_fields
from urbanframe.operators.quantile import lower_median
from urbanframe.operators.runlog import extract_metric, median_lines
from urbanframe.operators.setops import union_all
from urbanframe.operators.spatial import nearest_site, nearest_site_summary
from urbanframe.operators.window import top_k_per_group, top_k_with_ties

__all__ = [
    "JOIN_STRATEGIES",
    "argmin",
    "checked_broadcast",
    "count_at_least",
    "cross_join_count",
    "equi_join",
    "explode_array",
    "extract_metric",
    "flatten_struct",
    "heavy_key_join",
    "heavy_keys",
    "json_fields",
    "keyed_sums",
    "lower_median",
    "median_lines",
    "nearest_site",
    "nearest_site_summary",
    "measured_bytes",
    "reproducible_avg",
    "share_of_total",
    "top_k_per_group",
    "top_k_with_ties",
    "union_all",
    "with_strategy",
]
