"""s01-s12, s17: spectra files as two tables, scans and peaks.

Files are read by Spark's binary reader and decoded one file at a time by the
workers; schemas are fixed, so nothing is inferred.
"""

from __future__ import annotations

import base64
import io
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import ship

SCANS = "sample string, scan_id string, idx int, filter_string string, time double, ms_level int, polarity int, precursor_id string, target_mz double, max_i double, tic double"
RAW = SCANS + ", mz array<double>, i array<double>"
CSV_PEAKS = "scanNum int, filterLine string, retTime double, mz double, i double, r double, n double, z double, charge int"


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def decode_array(text: str | None, double: bool, packed: bool, big: bool = False) -> np.ndarray:
    """Base64 numbers, 32 or 64 bits wide, perhaps deflated."""
    raw = base64.b64decode(text or "")
    if packed and raw:
        raw = zlib.decompress(raw)
    return np.frombuffer(raw, (">" if big else "<") + ("f8" if double else "f4")).astype(float)


def parse_mzml(content: bytes) -> Iterator[dict]:
    """Spectra of an mzML file, as they stream by."""
    for _, e in ET.iterparse(io.BytesIO(content), events=("end",)):
        if _tag(e) != "spectrum":
            continue
        cv: dict[str, str] = {}
        out = {"scan_id": e.get("id"), "idx": int(e.get("index") or 0), "filter_string": None, "time": None, "precursor_id": None, "target_mz": None, "mz": np.zeros(0), "i": np.zeros(0)}
        for x in e.iter():
            t = _tag(x)
            if t == "cvParam":
                name = x.get("name")
                cv[name] = x.get("value") or ""
                if name == "scan start time":
                    out["time"] = float(x.get("value")) / (60.0 if x.get("unitName") == "second" else 1.0)
                elif name == "filter string":
                    out["filter_string"] = x.get("value")
                elif name == "isolation window target m/z":
                    out["target_mz"] = float(x.get("value"))
            elif t == "precursor":
                out["precursor_id"] = x.get("spectrumRef")
            elif t == "binaryDataArray":
                names = {c.get("name") for c in x if _tag(c) == "cvParam"}
                data = next((c.text for c in x if _tag(c) == "binary"), "")
                values = decode_array(data, "64-bit float" in names, "zlib compression" in names)
                out["mz" if "m/z array" in names else "i"] = values
        out["ms_level"] = int(cv.get("ms level") or 1)
        out["polarity"] = 1 if "positive scan" in cv else -1 if "negative scan" in cv else 0
        out["max_i"] = float(cv["base peak intensity"]) if cv.get("base peak intensity") else float(out["i"].max(initial=0.0))
        out["tic"] = float(cv["total ion current"]) if cv.get("total ion current") else float(out["i"].sum())
        e.clear()
        yield out


def parse_mzxml(content: bytes) -> Iterator[dict]:
    """Scans of an mzXML file: nested scans, big-endian pairs, times like PT12.3S."""
    level: list[str] = []
    n = 0
    for event, e in ET.iterparse(io.BytesIO(content), events=("start", "end")):
        if _tag(e) != "scan":
            continue
        if event == "start":
            level.append(e.get("num"))
            continue
        level.pop()
        prec = next((x for x in e if _tag(x) == "precursorMz"), None)
        peaks = next((x for x in e if _tag(x) == "peaks"), None)
        mz = i = np.zeros(0)
        if peaks is not None and peaks.text:
            raw = base64.b64decode(peaks.text)
            if (peaks.get("compressionType") or "none") == "zlib":
                raw = zlib.decompress(raw)
            wide = peaks.get("precision") == "64"
            v = np.frombuffer(raw, ">f8" if wide else ">f4").astype(float)
            mz, i = v[0::2], v[1::2]
        rt = (e.get("retentionTime") or "PT0S").removeprefix("PT").removesuffix("S")
        yield {
            "scan_id": e.get("num"),
            "idx": n,
            "filter_string": e.get("filterLine"),
            "time": float(rt) / 60,
            "ms_level": int(e.get("msLevel") or 1),
            "polarity": {"+": 1, "-": -1}.get(e.get("polarity"), 0),
            "precursor_id": (prec.get("precursorScanNum") if prec is not None else None) or (level[-1] if level else None),
            "target_mz": float(prec.text) if prec is not None else None,
            "max_i": float(e.get("basePeakIntensity") or i.max(initial=0.0)),
            "tic": float(e.get("totIonCurrent") or i.sum()),
            "mz": mz,
            "i": i,
        }
        n += 1
        e.clear()


def read_raw(spark: SparkSession, path: str, kind: str = "mzML") -> DataFrame:
    """One row per scan with its peak arrays; ``kind`` is mzML or mzXML; hidden files are skipped."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"[!.]*.{kind}").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = parse_mzml if kind.lower() == "mzml" else parse_mzxml
        names = [x.split()[0] for x in RAW.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[dict] = []
                for r in parse(content.as_py()):
                    rows.append({"sample": path_.rpartition("/")[2], **r})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return files.mapInArrow(run, RAW)


def scans_and_peaks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """s08: (scans, peaks) of raw scans."""
    peaks = raw.select("sample", "scan_id", F.explode(F.arrays_zip("mz", "i")).alias("p")).select("sample", "scan_id", F.col("p.mz").alias("mz"), F.col("p.i").alias("i"))
    return raw.drop("mz", "i"), peaks


def xic(scans: DataFrame, peaks: DataFrame, t0: float, t1: float, mz0: float, mz1: float, key: str = "scan_id") -> DataFrame:
    """s03: summed intensity in a mass window for each MS1 scan of a time range; scans without a hit give 0."""
    s = scans.where((F.col("ms_level") == 1) & F.col("time").between(t0, t1)).select(key, "time")
    p = peaks.where(F.col("mz").between(mz0, mz1)).groupBy(key).agg(F.sum("i").alias("_i"))
    return s.join(p, key, "left").select(key, "time", F.coalesce("_i", F.lit(0.0)).alias("i"))


def scan_list(scans: DataFrame, t0: float, t1: float) -> DataFrame:
    """s02."""
    return scans.where(F.col("time").between(t0, t1)).select("time", "target_mz")


def time_span(scans: DataFrame) -> DataFrame:
    """s02."""
    return scans.agg(F.min("time").alias("first"), F.max("time").alias("last"))


#: The order of the rows of a table of Parquet files, as ties of :func:`closest`: by file, then by place in it.
INPUT_ORDER = ("_metadata.file_path", "_metadata.row_index")


def closest(df: DataFrame, key: str, value: float, *ties: str) -> DataFrame:
    """s04: the row whose key is nearest to a value; ties go to the smaller key, then to the least of ``ties`` (:data:`INPUT_ORDER`: to the first row read, as the reference's ``min``)."""
    return df.orderBy(F.abs(F.col(key) - value), key, *ties).limit(1)


def read_csv_peaks(spark: SparkSession, path: str) -> DataFrame:
    """s10: the nine-column peak list."""
    return spark.read.schema(CSV_PEAKS).csv(path)


def filter_line_fields(line: Column) -> dict[str, Column]:
    """s17: level, polarity and precursor of an instrument filter line."""
    return {
        "ms_level": F.when(F.contains(line, F.lit(" ms2 ")) | F.contains(line, F.lit("@")), 2).otherwise(1),
        "polarity": F.when(F.contains(line, F.lit(" + ")), 1).when(F.contains(line, F.lit(" - ")), -1).otherwise(0),
        "precursor": F.regexp_extract(line, r"(\d*\.\d*)@", 1).try_cast("double"),
    }


def scans_of_peaks(peaks: DataFrame) -> DataFrame:
    """s17: one row per scan of a flat peak list; where its rows differ that with the least time and line."""
    f = filter_line_fields(F.col("filterLine"))
    first = peaks.groupBy("scanNum").agg(F.min(F.struct("retTime", "filterLine")).alias("_r")).select("scanNum", "_r.filterLine", "_r.retTime")
    return first.select("scanNum", "filterLine", "retTime", *[c.alias(n) for n, c in f.items()])


def read_dta(spark: SparkSession, path: str) -> DataFrame:
    """s11: `.dta` fragment spectra: the first line has precursor and charge; polarity is in the folder's name."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dta").text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    a = t.select("file", lines.alias("l"))
    num = lambda x, k: F.get(F.split(F.trim(x), r"\s+"), k).cast("double")
    head = F.get("l", 0)
    rows = a.select("file", num(head, 0).alias("precursor"), num(head, 1).cast("int").alias("charge"), F.explode(F.slice("l", 2, F.size("l"))).alias("p"))
    return rows.select("file", F.when(F.contains("file", F.lit("neg_")), -1).otherwise(1).alias("polarity"), "precursor", "charge", num(F.col("p"), 0).alias("mz"), num(F.col("p"), 1).alias("i"))


def groups(spark: SparkSession, path: str) -> DataFrame:
    """s13: occupation groups, one line each: name, then samples, separated by commas."""
    t = spark.read.text(path).where(F.trim("value") != "")
    parts = F.transform(F.split("value", "[,:;\t]"), lambda x: F.trim(x))
    return t.select(F.get(parts, 0).alias("grp"), F.explode(F.slice(parts, 2, F.size(parts))).alias("sample")).where("sample <> ''")


def pack_floats(values: list[float], big: bool = True) -> str:
    """Base64 of 32-bit numbers (for tests and writers)."""
    return base64.b64encode(struct.pack((">" if big else "<") + f"{len(values)}f", *values)).decode()
