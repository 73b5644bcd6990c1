from urbanframe.sources.readers import (
    csv_header,
    csv_headers,
    flatten_features,
    geojson_schema,
    parse_csv_lines,
    read_csv,
    read_geojson_properties,
    read_lines,
    read_table,
    string_schema,
)
from urbanframe.sources.sinks import (
    ConversionError,
    convert_csv_to_parquet,
    convert_verified,
    default_output_path,
    read_tuple_text,
    row_checksum,
    tuple_lines,
    write_parquet,
    write_result,
    write_tuple_text,
)

__all__ = [
    "ConversionError",
    "convert_csv_to_parquet",
    "convert_verified",
    "default_output_path",
    "csv_header",
    "csv_headers",
    "flatten_features",
    "geojson_schema",
    "parse_csv_lines",
    "read_csv",
    "read_geojson_properties",
    "read_lines",
    "read_table",
    "read_tuple_text",
    "row_checksum",
    "string_schema",
    "tuple_lines",
    "write_parquet",
    "write_result",
    "write_tuple_text",
]
