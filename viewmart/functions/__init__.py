"""Column builders: pure expressions, no I/O, no actions."""

from viewmart.functions.numeric import bands, clip, exact, exact_avg, ladder, score, truncate
from viewmart.functions.temporal import days_until, elapsed_days, elapsed_hours
from viewmart.functions.text import null_tokens_to_null, title_case

__all__ = [
    "bands", "clip", "days_until", "elapsed_days", "elapsed_hours", "exact", "exact_avg", "ladder",
    "null_tokens_to_null", "score", "title_case", "truncate",
]
