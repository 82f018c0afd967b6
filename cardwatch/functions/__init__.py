"""Column functions: every one takes and returns Columns and stays in codegen."""

from cardwatch.functions.geo import geo_cell, haversine_km, latlon_to_xyz, staging_distance
from cardwatch.functions.numbers import (
    class_label,
    json_number,
    list_contains,
    map_get,
    percent,
    percent_text,
    ratio_half_up,
)
from cardwatch.functions.text import (
    bin_file_name,
    card_hash,
    iso_utc,
    leaf_name,
    run_model_type,
    run_ratio,
    strip_prefix,
    underscored,
    version_label,
)
from cardwatch.functions.time import (
    age,
    as_instant,
    cyclic_columns,
    decode_cycle,
    decode_month,
    epoch_micros,
    parse_date,
    parse_timestamp,
    txn_day,
    wall_clock,
)

__all__ = [
    "age", "as_instant", "bin_file_name", "card_hash", "class_label", "cyclic_columns", "decode_cycle", "decode_month",
    "epoch_micros", "geo_cell", "haversine_km", "iso_utc", "json_number", "latlon_to_xyz", "leaf_name",
    "list_contains", "map_get", "parse_date", "parse_timestamp", "percent", "percent_text",
    "ratio_half_up", "run_model_type", "run_ratio", "staging_distance", "strip_prefix", "txn_day",
    "underscored", "version_label", "wall_clock",
]
