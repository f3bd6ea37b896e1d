from .integrity import key_violations, matched, orphan_summary, orphans, top_key_check
from .profile import all_null_rows, column_duplicates, column_profile, describe_numeric, describe_strings, distinct_counts, duplicate_rows, exact_quantiles, null_counts, schema_frame, table_profile, volume
from .reconcile import reconcile
from .report import category_report, frequency, global_stats, grouped_stats, listing, nonpositive, recurrence, sample_rows, share_of_total, top_key, value_range

__all__ = ["all_null_rows", "category_report", "column_duplicates", "column_profile", "describe_numeric", "describe_strings", "distinct_counts", "duplicate_rows", "exact_quantiles", "frequency", "global_stats", "grouped_stats", "key_violations", "listing", "matched", "nonpositive", "null_counts", "orphan_summary", "orphans", "reconcile", "recurrence", "sample_rows", "schema_frame", "share_of_total", "table_profile", "top_key", "top_key_check", "value_range", "volume"]
