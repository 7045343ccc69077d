"""Readers of the weather service's binary products, and text sinks and sources.

Files are listed and read by Spark (``binaryFile``), so any store that Spark can open works
and files are spread over the tasks; a file is decoded in numpy and its cells come out as
rows. Missing cells are null.
"""

from __future__ import annotations

import bz2
import datetime as dt
import gzip
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header keys of composites and of site products and the tilt product.
COMPOSITE_KEYS = ("BY", "VS", "SW", "PR", "INT", "GP", "MS", "LV", "CS", "MX", "BG", "ST", "VV", "MF", "QN", "VR", "U")
SITE_KEYS = (*COMPOSITE_KEYS, "CO", "CD", "MH", "HI", "CI", "CL", "FL")
TILT_KEYS = ("BY", "VS", "CO", "CD", "CS", "EP", "MS")
#: Products of one byte a cell; flag bits of two-byte cells.
BYTE_PRODUCTS = ("RX", "EX", "WX")
SECONDARY, NODATA, NEGATIVE, CLUTTER, VALUE = 0x1000, 0x2000, 0x4000, 0x8000, 0x0FFF
END_OF_HEADER = b"\x03"
#: Products of run-length lines, and what stands for no data in them.
RUN_PRODUCTS, RUN_NODATA = ("PG", "PC"), 255


def opened(content: bytes) -> bytes:
    if content[:2] == b"\x1f\x8b":
        return gzip.decompress(content)
    return bz2.decompress(content) if content[:3] == b"BZh" else content


def sections(header: str, keys: tuple[str, ...]) -> dict[str, str]:
    """The text after each key, up to the next key; a key counts where it stands last."""
    starts = {k: p for k in keys if (p := header.rfind(k)) >= 0}
    stops = sorted([*starts.values(), len(header)])
    return {k: header[p + len(k) : next(s for s in stops if s > p)] for k, p in starts.items()}


def product_time(header: str) -> dt.datetime:
    """Day, hour and minute, then the site, then month and year."""
    day, hour, minute, month, year = (int(header[a : a + 2]) for a in (2, 4, 6, 13, 15))
    return dt.datetime(2000 + year, month, day, hour, minute)


def parse_composite_header(header: str) -> dict:
    """The entries of a composite's or site product's header by plain names."""
    part = sections(header, SITE_KEYS)
    out: dict = {"product": header[:2], "time": product_time(header), "site": header[8:13], "rows": 200, "cols": 200}
    number = {"VS": "format_version", "CS": "indicator", "MX": "image_count", "VV": "prediction_minutes", "MF": "module_flags", "QN": "quantification", "MH": "max_height"}
    for key, text in part.items():
        if key in number and re.fullmatch(r"\s*\d+\s*", text):
            out[number[key]] = int(text)
        elif key in ("SW", "VR", "CO", "CD", "HI", "FL"):
            out[{"SW": "software", "VR": "reanalysis", "CO": "clutter_map", "CD": "doppler_filter", "HI": "hail_warning", "FL": "freezing_level"}[key]] = text.strip()
    if "BY" in part:
        out["data_bytes"] = int(part["BY"]) - len(header) - 1
    if "PR" in part:
        out["precision"] = float("1" + part["PR"].strip())
    if "INT" in part:
        out["interval_seconds"] = int(part["INT"]) * 60 * (1440 if part.get("U", "0").strip() == "1" else 1)
    if "GP" in part:
        out["rows"], out["cols"] = (int(x) for x in part["GP"].split("x"))
    if "BG" in part:
        half = len(part["BG"]) // 2
        out["rows"], out["cols"] = int(part["BG"][:half]), int(part["BG"][half:])
    if "LV" in part:
        out["levels"] = [float(x) for x in part["LV"].split()[1:]]
    for key, name in (("MS", "radars"), ("ST", "radar_days")):
        if found := re.search(rf"{key}[^<]*<([^>]*)>", header):
            out[name] = [x.strip() for x in found[1].split(",")]
    return out


def decode_composite(content: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """Header and flat arrays: value (NaN where missing), nodata, clutter, secondary."""
    data = opened(content)
    end = data.index(END_OF_HEADER)
    head = parse_composite_header(data[:end].decode("ascii", "replace"))
    cells, body = head["rows"] * head["cols"], data[end + 1 :]
    if head["product"] in RUN_PRODUCTS:
        levels = unpack_lines(body, head["cols"], head["rows"])[::-1].ravel()
        nodata = levels == RUN_NODATA
        named = np.array([*head.get("levels", []), *[np.nan] * 256], dtype=float)[:256] if head.get("levels") else np.arange(256.0)
        value, clutter, secondary = named[levels], np.zeros(cells, dtype=bool), np.zeros(cells, dtype=bool)
    elif head["product"] in BYTE_PRODUCTS:
        raw = np.frombuffer(body, np.uint8, cells)
        nodata, clutter = raw == 250, raw == 249
        value, secondary = raw / 2.0 - 32.5, np.zeros(cells, dtype=bool)
    else:
        if len(body) < 2 * cells:
            raise OSError(f"{head['product']}: {len(body)} bytes where {2 * cells} are needed")
        raw = np.frombuffer(body, "<u2", cells)
        nodata, clutter, secondary = ((raw & bit) != 0 for bit in (NODATA, CLUTTER, SECONDARY))
        value = (raw & VALUE).astype(float) * (np.where(raw & NEGATIVE, -1.0, 1.0) if head["product"] == "RD" else 1.0) * head.get("precision", 1.0)
    return head, {"value": np.where(nodata, np.nan, value), "nodata": nodata, "clutter": clutter, "secondary": secondary}


def unpack_line(line: bytes, cols: int) -> np.ndarray:
    """One line of levels. After the line's number come the cells without data, less 16 in each byte of which only the last is below 255,
    then bytes of a run's length (high half) and level (low half)."""
    out = np.full(cols, RUN_NODATA, dtype=np.uint8)
    codes = np.frombuffer(line, dtype=np.uint8)[1:].astype(np.int64)
    if len(codes):
        last = int(np.argmax(codes < 255))
        skip = int((codes[: last + 1] - 16).sum())
        runs = codes[last + 1 :]
        cells = np.repeat(runs & 15, runs >> 4)[: max(cols - skip, 0)]
        out[skip : skip + len(cells)] = cells
    return out


def unpack_lines(body: bytes, cols: int, rows: int) -> np.ndarray:
    """The lines of a run-length product, the southernmost last; lines that are not there have no data."""
    lines = [unpack_line(x, cols) for x in body.split(b"\n")[:rows] if x]
    return np.stack(lines + [np.full(cols, RUN_NODATA, dtype=np.uint8)] * (rows - len(lines)))


def unpack_beam(words: np.ndarray) -> np.ndarray:
    """A beam with its runs of zeros spelled out: words with bit 12 set stand for so many zeros."""
    run = (words & 0x1000) != 0
    return np.repeat(np.where(run, 0, words), np.where(run, words & 0x0FFF, 1))


def decode_tilt(content: bytes) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Header, azimuths, elevations and words (one row a beam) of a polar tilt product."""
    data = opened(content)
    end = data.index(END_OF_HEADER)
    while data[end + 1 : end + 2] == END_OF_HEADER:
        end += 1
    header = data[: end + 1].decode("ascii", "replace")
    part = sections(header, TILT_KEYS)
    head = {"product": header[:2], "time": product_time(header), "site": header[8:13], "version": part.get("VS", "").strip()}
    size = int(part["BY"]) - len(header)
    words = np.frombuffer(data, "<u2", (size - size % 2) // 2, end + 1)
    edges = np.append(np.flatnonzero(words == 0x2000), len(words))
    beams = [unpack_beam(words[a + 3 : b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    azimuth, elevation = ((words[edges[:-1] + k] & 0x0FFF) / 10.0 for k in (1, 2))
    return head, azimuth, elevation, np.stack(beams) if beams else np.zeros((0, 0), dtype=np.uint16)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_composites(spark: SparkSession, path: str) -> DataFrame:
    """One row per cell of every composite file at the path (globs too)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in batch.itertuples(index=False):
                head, cell = decode_composite(content)
                at = np.arange(len(cell["value"]))
                yield pd.DataFrame({"path": name, "product": head["product"], "time": head["time"], "row": at // head["cols"], "col": at % head["cols"], **cell})

    found = _files(spark, path).mapInPandas(rows, "path string, product string, time timestamp, row long, col long, value double, nodata boolean, clutter boolean, secondary boolean")
    return found.withColumn("value", F.nanvl("value", F.lit(None)))


def read_tilts(spark: SparkSession, path: str) -> DataFrame:
    """One row per gate of every polar tilt file at the path."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in batch.itertuples(index=False):
                head, az, el, words = decode_tilt(content)
                n, m = words.shape
                yield pd.DataFrame({
                    "path": name, "time": head["time"], "ray": np.repeat(np.arange(n), m), "bin": np.tile(np.arange(m), n), "azimuth": np.repeat(az, m), "elevation": np.repeat(el, m),
                    "dbz": ((words & 0x1FFF) * 0.5 - 32.5).ravel(), "clutter": ((words & 0x8000) != 0).ravel(),
                })

    return _files(spark, path).mapInPandas(rows, "path string, time timestamp, ray long, bin long, azimuth double, elevation double, dbz double, clutter boolean")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells of ESRI ASCII grids: path, row (0 at the top), col, x and y of the centre, value."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in batch.itertuples(index=False):
                lines = opened(content).decode().splitlines()
                head = {k.lower(): float(v) for k, v in (x.split() for x in lines if x[:1].isalpha())}
                v = np.array(" ".join(x for x in lines if not x[:1].isalpha()).split(), dtype=float)
                ny, nx, size = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
                at = np.arange(nx * ny)
                x = head.get("xllcorner", head.get("xllcenter", 0.0) - size / 2) + (at % nx + 0.5) * size
                y = head.get("yllcorner", head.get("yllcenter", 0.0) - size / 2) + (ny - at // nx - 0.5) * size
                yield pd.DataFrame({"path": name, "row": at // nx, "col": at % nx, "x": x, "y": y, "value": np.where(v == head.get("nodata_value", -9999.0), np.nan, v)})

    return _files(spark, path).mapInPandas(rows, "path string, row long, col long, x double, y double, value double").withColumn("value", F.nanvl("value", F.lit(None)))


def polygon_lines(polygons: DataFrame) -> DataFrame:
    """ESRI polygon text of ``polygons`` (id, ring of structs of x, y, z, m) as lines with an order; write it with one sorted partition."""
    head = F.struct(F.lit(-1).cast("long").alias("p"), F.lit(0).alias("k"), F.lit("Polygon").alias("value"))
    each = polygons.select("id", F.posexplode("ring").alias("k", "v"))
    body = each.select(F.col("id").alias("p"), (F.col("k") + 1).alias("k"), F.format_string("%d %f %f %f %f", "k", "v.x", "v.y", "v.z", "v.m").alias("value"))
    names = polygons.select(F.col("id").alias("p"), F.lit(0).alias("k"), F.format_string("%d 0", "id").alias("value"))
    ends = polygons.sparkSession.range(1).select(F.explode(F.array(head, F.struct(F.lit((1 << 62)).alias("p"), F.lit(0).alias("k"), F.lit("END").alias("value")))).alias("s")).select("s.*")
    return body.unionByName(names).unionByName(ends)


def write_polygon_text(polygons: DataFrame, path: str) -> None:
    polygon_lines(polygons).repartitionByRange(1, "p", "k").sortWithinPartitions("p", "k").select("value").write.mode("overwrite").text(path)
