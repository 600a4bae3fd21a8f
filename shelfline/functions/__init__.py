from shelfline.functions.columns import (  # noqa: F401
    average_or_none, bucket_right_closed, clip, day_of_week, half_even, iso_week, iso_year,
    label_map, month_start, percent, safe_ratio, sum0, week_distance,
)
