"""Readers and sinks: per-file CSV headers, quoting, GeoJSON, text, Parquet conversion."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import types as T

from urbanframe.sources import (
    convert_csv_to_parquet,
    csv_headers,
    parse_csv_lines,
    read_csv,
    read_geojson_properties,
    read_lines,
    read_table,
    write_result,
    write_tuple_text,
)
from urbanframe.sources.splits import session_settings


def write_text(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_csv_quotes_are_decoded(spark, tmp_path):
    p = write_text(tmp_path / "q.csv", 'ID,Premis\n1,"X, ""Y"""\n')
    assert read_csv(spark, p).first()["Premis"] == 'X, "Y"'


def test_csv_second_file_same_order_is_read(spark, tmp_path):
    a = write_text(tmp_path / "a.csv", "ID,AREA,Premis\n1,7,STREET\n")
    b = write_text(tmp_path / "b.csv", "ID,AREA,Premis\n2,8,PARK\n")
    got = sorted(tuple(r) for r in read_csv(spark, [a, b]).collect())
    assert got == [("1", "7", "STREET"), ("2", "8", "PARK")]


def test_csv_reordered_header_is_rejected(spark, tmp_path):
    a = write_text(tmp_path / "a.csv", "ID,AREA,Premis\n1,7,STREET\n")
    b = write_text(tmp_path / "b.csv", "Premis,ID,AREA\nSTREET,2,8\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, [a, b], columns=["ID", "AREA", "Premis"]).collect()


def test_csv_files_are_joined_by_column_name(spark, tmp_path):
    a = write_text(tmp_path / "a.csv", "ID,AREA,Premis\n1,7,STREET\n")
    b = write_text(tmp_path / "b.csv", "Premis,ID,AREA\nSTREET,2,8\n")
    c = write_text(tmp_path / "c.csv", 'Premis,"Odd, ""name""",ID\r\nPARK,x,3\r\n')
    empty = write_text(tmp_path / "d.csv", "")
    only_header = write_text(tmp_path / "e.csv", "ID,AREA,Premis\n")
    names = csv_headers(spark, [a, b, c, empty, only_header])
    assert {k: len(v) for k, v in names.items()} == {
        ("ID", "AREA", "Premis"): 2, ("Premis", "ID", "AREA"): 1, ("Premis", 'Odd, "name"', "ID"): 1
    }
    for quoted in (False, True):
        df = read_csv(spark, [a, b, c, empty, only_header], quoted_newlines=quoted)
        got = {r["ID"]: (r["AREA"], r["Premis"], r['Odd, "name"']) for r in df.collect()}
        assert got == {"1": ("7", "STREET", None), "2": ("8", "STREET", None), "3": (None, "PARK", "x")}


def test_header_catalogue_reads_one_line_of_every_file(spark, tmp_path):
    paths = [write_text(tmp_path / f"{i:02d}.csv", f"ID,C{i % 3}\n" + "1,2\n" * 5000) for i in range(12)]
    with session_settings(spark, {"spark.sql.files.maxPartitionBytes": "4000"}):  # many splits a file
        names = csv_headers(spark, paths)
    assert {k: len(v) for k, v in names.items()} == {("ID", f"C{i}"): 4 for i in range(3)}


PIECES = ["a", "b,c", '""', "\n", "\r\n", "\n\n", "é", "\\", "\\n", "\0", " "]


@pytest.mark.parametrize("split_bytes", [40, 100_000])
def test_quoted_line_breaks_across_splits(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    expected, paths = [], []
    for f in range(3):
        lines = ["k,t,u"]
        for i in range(50):
            t, u = ("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6))) for _ in range(2))
            lines.append(f'{f}-{i},"{t}","{u}"')
            expected.append((f"{f}-{i}", t.replace('""', '"'), u.replace('""', '"')))
        paths.append(str(tmp_path / f"{f}.csv"))
        end = "\r\n" if f == 1 else "\n"
        Path(paths[-1]).write_bytes((end.join(lines) + (end if f else "")).encode())
    df = read_csv(spark, paths, quoted_newlines=True, split_bytes=split_bytes)
    assert sorted(tuple(r) for r in df.collect()) == sorted(expected)


def test_one_value_over_many_splits_and_an_open_quote(spark, tmp_path):
    long = "\n".join(f"line {i}" for i in range(500))
    p = write_text(tmp_path / "a.csv", f'k,t\n1,"{long}"\n2,x\n3,\n')
    got = sorted(tuple(r) for r in read_csv(spark, p, quoted_newlines=True, split_bytes=200).collect())
    assert got == [("1", long), ("2", "x"), ("3", None)]
    broken = write_text(tmp_path / "broken.csv", 'k,t\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="broken.csv.*quote"):
        read_csv(spark, [p, broken], columns=["k", "t"], quoted_newlines=True)


PROPERTIES = T.StructType([T.StructField("z", T.StringType()), T.StructField("n", T.LongType())])


def geojson_text(features, layout):
    body = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": features, "bbox": [1, [2]]}
    if layout == "trailing":
        return "{\n\"type\": \"FeatureCollection\",\n\"features\": [\n" + ",\n".join(map(json.dumps, features)) + "]}"
    if layout == "several":
        return "".join(geojson_text(features[i::3], "one line") + "\n \n" for i in range(3))
    return json.dumps(body, indent=2 if layout == "pretty" else None, ensure_ascii=layout != "pretty")


@pytest.mark.parametrize("split_bytes", [60, 100_000])
@pytest.mark.parametrize("layout", ["one line", "pretty", "trailing", "several"])
def test_geojson_document_of_any_layout_is_split(spark, tmp_path, layout, split_bytes):
    rng = random.Random(3)
    odd = ['}', '{"', "]}", '\\"', "é", "\\\\", "\n", ",{", '"features": [']
    features = []
    for i in range(30):
        z = "".join(rng.choice(odd) for _ in range(rng.randint(0, 5)))
        shape = {"type": "Polygon", "coordinates": [[[0, 1.5], [2, 3]]], "parts": [{"a": [{}]}, {}]}
        features.append({"type": "Feature", "properties": {"z": z, "n": i}, "geometry": rng.choice([None, shape])})
    p = tmp_path / "doc.geojson"
    p.write_text(geojson_text(features, layout), encoding="utf-8")
    got = read_geojson_properties(spark, str(p), PROPERTIES, split_bytes=split_bytes).collect()
    assert sorted((r["n"], r["z"]) for r in got) == [(i, f["properties"]["z"]) for i, f in enumerate(features)]


def test_geojson_edges(spark, tmp_path):
    for i, text in enumerate(['{"type": "FeatureCollection", "features": []}', "", "\n", '{"features": [], "x": {}}\n']):
        p = write_text(tmp_path / f"{i}.geojson", text)
        assert read_geojson_properties(spark, p, PROPERTIES).collect() == []
    cut = write_text(tmp_path / "cut.geojson", '{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}}, {"type"')
    with pytest.raises(ValueError, match="cut.geojson.*ends inside"):
        read_geojson_properties(spark, cut, PROPERTIES)
    wrong = write_text(tmp_path / "wrong.geojson", '{"features": [{"type": "Feature", "properties": {"n": oops}}]}')
    with pytest.raises(Exception):
        read_geojson_properties(spark, wrong, PROPERTIES).collect()


def test_delimited_and_format_switch(spark, tmp_path):
    p = write_text(tmp_path / "i.csv", 'Zip Code;Estimated Median Income\n90001;"$52,806"\n')
    df = read_table(spark, p, fmt="csv", sep=";")
    assert tuple(df.first()) == ("90001", "$52,806")
    with pytest.raises(ValueError):
        read_table(spark, p, fmt="xml")


def test_parse_csv_lines_handles_blank_lines(spark, tmp_path):
    p = write_text(tmp_path / "l.txt", '90001;"$1,000"\n\n90002;$5\n')
    parsed = parse_csv_lines(read_lines(spark, p), ["zip", "income"], sep=";")
    got = sorted((r["zip"] or "", r["income"] or "") for r in parsed.collect())
    assert ("90001", "$1,000") in got and ("90002", "$5") in got


def test_geojson_properties_with_declared_schema(spark, tmp_path):
    doc = """{
      "type": "FeatureCollection",
      "features": [
        {"type": "Feature", "properties": {"ZCTA20": "90001", "POP20": 6, "HOUSING20": 3},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"ZCTA20": "90002", "POP20": 4}, "geometry": null}
      ]
    }"""
    p = write_text(tmp_path / "blocks.geojson", doc)
    props = T.StructType(
        [T.StructField("ZCTA20", T.StringType()), T.StructField("POP20", T.LongType()), T.StructField("HOUSING20", T.LongType())]
    )
    got = sorted(tuple(r) for r in read_geojson_properties(spark, p, props).collect())
    assert got == [("90001", 6, 3), ("90002", 4, None)]


def test_convert_and_result_sinks(spark, tmp_path):
    a = write_text(tmp_path / "in" / "a.csv", "DR_NO,TIME OCC\n1,0530\n2,2100\n")
    n = convert_csv_to_parquet(spark, [a], str(tmp_path / "pq"))
    assert n == 2
    back = spark.read.parquet(str(tmp_path / "pq"))
    assert back.columns == ["DR_NO", "TIME OCC"]
    write_result(back, str(tmp_path / "out"), single_file=True)
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 1


def test_tuple_text_sink_header_first(spark, tmp_path):
    df = spark.createDataFrame([("Night", 33.33), ("Morning", 16.67)], "day_period string, percentage double")
    out = str(tmp_path / "t")
    write_tuple_text(df, out, ["day_period", "percentage"], [True, False])
    files = sorted((tmp_path / "t").glob("part-*"))
    lines = [ln for f in files for ln in f.read_text().splitlines()]
    assert lines[0] == "('day_period', 'percentage')"
    assert sorted(lines[1:]) == ["('Morning', 16.67)", "('Night', 33.33)"]


def test_geojson_line_delimited_collections(spark, tmp_path):
    lines = "\n".join(
        '{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"ZCTA20": "%s", "POP20": %d}}]}'
        % (z, n)
        for z, n in [("90001", 1), ("90002", 2), ("90001", 3)]
    )
    p = write_text(tmp_path / "blocks.jsonl", lines + "\n")
    props = T.StructType([T.StructField("ZCTA20", T.StringType()), T.StructField("POP20", T.LongType())])
    got = sorted(tuple(r) for r in read_geojson_properties(spark, p, props, layout="lines").collect())
    assert got == [("90001", 1), ("90001", 3), ("90002", 2)]


def test_default_output_path_and_result_formats(spark, tmp_path):
    from urbanframe.sources import default_output_path

    out = default_output_path(spark, str(tmp_path) + "/", "q1")
    assert out == f"{tmp_path}/q1_{spark.sparkContext.applicationId}"
    df = spark.createDataFrame([("Night", 33.33)], "day_period string, percentage double")
    write_result(df, out, fmt="parquet")
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("Night", 33.33)]
    with pytest.raises(ValueError):
        write_result(df, out, fmt="xml")


def test_line_breaks_are_refused_or_escaped(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c\\n\r"), (3, None), (4, "a\0b\\\\n")], "k int, t string")
    with pytest.raises(Exception, match="line break"):
        write_result(df, str(tmp_path / "refused"))
    write_result(df, str(tmp_path / "escaped"), newlines="escape")
    back = read_csv(spark, str(tmp_path / "escaped"), escaped_newlines=True)
    assert sorted(tuple(r) for r in back.collect()) == [("1", "a\nb"), ("2", "c\\n\r"), ("3", None), ("4", "a\0b\\\\n")]


def test_round_trips_keep_null_keys(spark):
    from urbanframe.plans.roundtrip import csv_folders, csv_parquet_round_trip

    df = spark.createDataFrame([(None, 'a "b", c'), (1, "x\ny"), (2, "z")], "k long, t string")
    assert sorted(map(repr, map(tuple, csv_parquet_round_trip(spark, df).collect()))) == sorted(map(repr, map(tuple, df.collect())))
    plain = df.filter("t <> 'x\ny'")
    assert read_csv(spark, csv_folders(spark, plain, "t"), columns=["k", "t"]).count() == 2
