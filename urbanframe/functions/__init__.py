from urbanframe.functions.scalars import (
    CRIME_TS_FORMAT,
    EARTH_RADIUS_KM,
    format_timestamp,
    haversine_km,
    money_text,
    parse_money,
    parse_timestamp,
    time_of_day,
    to_double,
    to_int,
    to_long,
    unit_vector,
)

__all__ = [
    "CRIME_TS_FORMAT",
    "EARTH_RADIUS_KM",
    "format_timestamp",
    "haversine_km",
    "money_text",
    "parse_money",
    "parse_timestamp",
    "time_of_day",
    "to_double",
    "to_int",
    "to_long",
    "unit_vector",
]
