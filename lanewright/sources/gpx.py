"""GPX: one file of track points a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions.scalar import number_text, xml_escape

CREATOR = "lanewright"


def track(coords: Column, name: Column) -> Column:
    """The text of a GPX 1.1 file for an array of (lat, lon, ele); a point
    without an elevation has no <ele>. No line end after the last line."""
    point = lambda p: F.concat(
        F.lit('      <trkpt lat="'), number_text(p["lat"]), F.lit('" lon="'), number_text(p["lon"]), F.lit('">'),
        F.coalesce(F.concat(F.lit("<ele>"), number_text(p["ele"]), F.lit("</ele>")), F.lit("")), F.lit("</trkpt>"),
    )
    # The prolog and the indentation of GPX 1.1.
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{CREATOR}" xmlns="http://www.topografix.com/GPX/1/1">\n  <trk><name>'
    return F.concat(F.lit(head), xml_escape(name), F.lit("</name><trkseg>\n"), F.array_join(F.transform(coords, point), "\n"), F.lit("\n  </trkseg></trk>\n</gpx>"))


def tracks(runs: DataFrame, title: str = "Run ") -> DataFrame:
    """(request_id, run_id, file_name, gpx) of a run table; file names are
    unique within a request."""
    name = F.concat(F.lit(title), F.col("run_id").cast("string"))
    return runs.select("request_id", "run_id", F.concat(F.lit("run_"), F.col("run_id").cast("string"), F.lit(".gpx")).alias("file_name"), track(F.col("coords"), name).alias("gpx"))


def write_tracks(runs: DataFrame, path: str, title: str = "Run ") -> None:
    """One folder a run, request_id=../run_id=.., with its track as text and a
    line end after it."""
    out = tracks(runs, title).select("request_id", "run_id", "gpx")
    out.repartition("request_id", "run_id").write.partitionBy("request_id", "run_id").text(path)
