import base64
import struct
import zlib

from massweave.sources import project, sinks, spectra

MZML = """<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>
<spectrum index="0" id="scan=1"><cvParam name="ms level" value="1"/><cvParam name="positive scan"/><scanList><scan><cvParam name="scan start time" value="30" unitName="second"/><cvParam name="filter string" value="FTMS + p NSI Full ms"/></scan></scanList>
<binaryDataArrayList><binaryDataArray><cvParam name="64-bit float"/><cvParam name="zlib compression"/><cvParam name="m/z array"/><binary>{mz}</binary></binaryDataArray>
<binaryDataArray><cvParam name="32-bit float"/><cvParam name="no compression"/><cvParam name="intensity array"/><binary>{i}</binary></binaryDataArray></binaryDataArrayList></spectrum>
</spectrumList></run></mzML>"""


def test_mzml(spark, tmp_path):
    mz = base64.b64encode(zlib.compress(struct.pack("<3d", 100.0, 200.5, 300.25))).decode()
    i = base64.b64encode(struct.pack("<3f", 1.0, 5.0, 2.0)).decode()
    (tmp_path / "a.mzML").write_text(MZML.format(mz=mz, i=i))
    (tmp_path / ".hidden.mzML").write_text("no xml")
    raw = spectra.read_raw(spark, str(tmp_path))
    scans, peaks = spectra.scans_and_peaks(raw)
    s = scans.first()
    assert (s.scan_id, s.time, s.ms_level, s.polarity, s.max_i, s.tic) == ("scan=1", 0.5, 1, 1, 5.0, 8.0)
    assert sorted((r.mz, r.i) for r in peaks.collect()) == [(100.0, 1.0), (200.5, 5.0), (300.25, 2.0)]
    assert spectra.xic(scans, peaks, 0, 1, 150, 250).first().i == 5.0


def test_mzxml(spark, tmp_path):
    p = spectra.pack_floats([100.0, 7.0, 150.0, 3.0])
    (tmp_path / "a.mzXML").write_text(f'<mzXML><msRun><scan num="1" msLevel="1" polarity="-" retentionTime="PT60S"><peaks precision="32">{p}</peaks><scan num="2" msLevel="2" polarity="-" retentionTime="PT61.5S"><precursorMz>150.5</precursorMz><peaks precision="32">{p}</peaks></scan></scan></msRun></mzXML>')
    rows = {r.scan_id: r for r in spectra.read_raw(spark, str(tmp_path), "mzXML").collect()}
    assert rows["2"].target_mz == 150.5 and rows["2"].precursor_id == "1" and rows["1"].polarity == -1
    assert list(rows["1"].mz) == [100.0, 150.0] and rows["1"].time == 1.0


def test_project():
    p = project.load("[project]\nMSresolution = auto\nMStolerance = 5 ppm\ntimerange = (0, 30.5)\nx = True\n[mfql]\nq = text\n")
    assert p.options["MStolerance"] == (5.0, "ppm") and p.options["timerange"] == (0, 30.5) and p.options["x"] is True
    assert p.options["alignmentMethodMS"] == "calctol" and p.queries == {"q": "text"}


def test_report_lines(spark):
    a = spark.createDataFrame([("x", 1)], "s string, n int")
    b = spark.createDataFrame([("y",)], "s string")
    lines = [r.line for r in sinks.report_lines({"a": a, "b": b}).orderBy("ord1", "ord2").collect()]
    assert lines == ["s,n", "###,a", "x,1", "###,b", "y,"]


def test_report_keeps_the_order_of_rows(spark, tmp_path):
    from massweave.sources import sinks

    rows = [(f"name{9 - i}", i) for i in range(10)]
    df = spark.createDataFrame(rows, "specie string, n int").coalesce(1)
    sinks.write_report({"q": df}, str(tmp_path / "report"))
    lines = [x for f in sorted((tmp_path / "report").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["specie,n", "###,q", *[f"{a},{b}" for a, b in rows]]


def test_scans_of_a_flat_peak_list(spark):
    from massweave.sources import spectra

    rows = [(1, "FTMS + p NSI Full ms [1-2]", 2.0), (1, "FTMS + p NSI Full ms [1-2]", 1.0), (2, "FTMS - p NSI Full ms2 404.39@hcd12.50 [1-2]", 3.0)]
    out = spectra.scans_of_peaks(spark.createDataFrame(rows, "scanNum int, filterLine string, retTime double").repartition(3)).collect()
    assert sorted((r.scanNum, r.retTime, r.ms_level, r.polarity, r.precursor) for r in out) == [(1, 1.0, 1, 1, None), (2, 3.0, 2, -1, 404.39)]


def test_closest_breaks_ties(spark):
    """s04: of equal keys the row with the least id, wherever it lies."""
    df = spark.createDataFrame([(k, 10.0) for k in (9, 4, 7, 2, 8)], "id int, mz double").repartition(3)
    assert spectra.closest(df, "mz", 10.1, "id").first().id == 2


def test_closest_takes_the_first_copy(spark, tmp_path):
    """s04: of peaks with equal masses the first of the input, as DuckDB returns with one thread, wherever the least id lies."""
    import duckdb

    from massweave import catalog

    con = duckdb.connect()
    con.sql("set threads=1")
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for k, keys in enumerate(([90, 70, 80], [10, 60], [20])):  # the copies of the nearest mass come after two rows farther off
        rows = ", ".join(f"({o}::bigint, {p})" for o, p in [(1, 50000.0), (2, 51300.0), *[(o, 51234.5) for o in keys]])
        con.sql(f"copy (select o as l_orderkey, 1::bigint as l_partkey, 1::bigint as l_suppkey, 1 as l_linenumber, 1.0::double as l_quantity, p::double as l_extendedprice, 0.0::double as l_discount, 'A' as l_returnflag, 'F' as l_linestatus from (values {rows}) v(o, p)) to '{folder}/part-{k}.parquet' (format parquet)")
    con.sql(f"create view lineitem as select * from '{folder}/*.parquet'")
    con.sql("create view orders as select 1 as o_orderkey, 'F' as o_orderstatus, 1.0 as o_totalprice, 1 as o_custkey")
    con.sql("create view part as select 1 as p_partkey, 1.0 as p_retailprice, 'x' as p_type")
    got = [tuple(r) for r in catalog.queries()["s04_closest"](spark, str(tmp_path)).collect()]
    assert got == con.sql(catalog.oracle_sql()["s04_closest"]).fetchall()
    assert got[0][0] // 10**11 == 90
