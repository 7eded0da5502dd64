from .text import (
    band,
    camel_case,
    decode,
    dotted_to_underscored,
    exclude,
    in_state,
    memory_pool_name,
    size_to_kb,
    string_to_array,
    template_url,
)
from .timefns import (
    elapsed_to_minutes,
    elapsed_to_seconds,
    epoch_millis,
    epoch_seconds,
    http_date_to_epoch,
    iso_gmt_to_epoch,
    local_to_utc,
    now_iso_gmt,
    uptime_seconds,
    utc_to_local,
    within_lookback,
    zoned_text_to_epoch,
)
from .units import guard_negative, hit_ratio, mean_latency, pct, ratio, to_double, to_int, to_unit

__all__ = [
    "band", "camel_case", "decode", "dotted_to_underscored", "elapsed_to_minutes",
    "elapsed_to_seconds", "epoch_millis", "epoch_seconds", "exclude", "guard_negative",
    "hit_ratio", "http_date_to_epoch", "in_state", "iso_gmt_to_epoch", "local_to_utc", "mean_latency",
    "memory_pool_name", "now_iso_gmt", "pct", "ratio", "size_to_kb", "string_to_array",
    "template_url", "to_double", "to_int", "to_unit", "uptime_seconds", "utc_to_local",
    "within_lookback", "zoned_text_to_epoch",
]
