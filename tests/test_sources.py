"""Array files, workbooks, intakes and shards."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfront.operators import campaign, cards, ingest, stats
from skyfront.sources import arrays, tables, workbook


def matrix(df):
    return np.array([r.x for r in sorted(df.collect(), key=lambda r: r.id)], float)


@pytest.mark.parametrize("kind", ["<f8", "<f4", ">f8", "<i4", "|u1"])
def test_array_file_in_ranges(spark, tmp_path, kind):
    m = (np.arange(7 * 503) % 251).reshape(503, 7).astype(kind)
    np.save(tmp_path / "m.npy", m)
    df = arrays.read_array(spark, str(tmp_path / "m.npy"), size=m.itemsize * 7 * 50)
    assert df.rdd.getNumPartitions() == 11
    assert np.array_equal(matrix(df), m.astype(float)) and [r.id for r in df.orderBy("id").collect()] == list(range(503))
    assert np.array_equal(matrix(tables.read_matrix(spark, f"file://{tmp_path}/m.npy", 7)), m.astype(float))


def test_each_task_reads_its_own_bytes(tmp_path):
    """A range's rows are read though the file's other bytes are gone."""
    m = np.random.default_rng(0).random((100, 3))
    np.save(tmp_path / "m.npy", m)
    reader = arrays.ArrayReader(str(tmp_path / "m.npy"), 24 * 10)
    parts = reader.partitions()
    raw = bytearray((tmp_path / "m.npy").read_bytes())
    raw[parts[3].offset + 240 :] = b""
    raw[: parts[3].offset] = bytes(parts[3].offset)
    (tmp_path / "m.npy").write_bytes(raw)
    got = [b for b in reader.read(parts[3])]
    assert np.allclose(np.array(got[0].column("x").to_pylist()), m[30:40]) and got[0].column("id").to_pylist() == list(range(30, 40))
    with pytest.raises(ValueError, match="ends before"):
        list(reader.read(parts[5]))


def test_arrays_written_by_several_tasks(spark, tmp_path):
    m = np.random.default_rng(1).random((400, 5))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(400)], "id bigint, x array<double>").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        arrays.write_array(df, f"file://{tmp_path}/out.npy")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out.npy").iterdir())
    assert len(files) == 4 and all(f.name.startswith("part-") for f in files)
    assert np.array_equal(np.concatenate([np.load(f) for f in files]), m)
    assert np.array_equal(matrix(tables.read_matrix(spark, f"file://{tmp_path}/out.npy", 5)), m)
    with pytest.raises(FileExistsError):
        arrays.write_array(df, f"file://{tmp_path}/out.npy")


def test_arrays_that_are_wrong(spark, tmp_path):
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "text.npy", np.array([["a"]]))
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.arange(6.0).reshape(2, 3)))
    (tmp_path / "no.npy").write_bytes(b"hello")
    for name in ("cube", "text", "columns", "no"):
        with pytest.raises(Exception, match="matrix|numbers|no array"):
            arrays.ArrayReader(str(tmp_path / f"{name}.npy"), 100).partitions()
    with pytest.raises(FileNotFoundError):
        arrays.files_of(str(tmp_path / "absent.npy"))
    with pytest.raises(tables.ContractError):
        np.save(tmp_path / "m.npy", np.zeros((3, 2)))
        tables.read_matrix(spark, str(tmp_path / "m.npy"), 5)
    gap = spark.createDataFrame([(0, [1.0]), (2, [1.0])], "id bigint, x array<double>")
    with pytest.raises(Exception, match="was due"):
        arrays.write_array(gap, str(tmp_path / "gap.npy"))
    assert not [f for f in (tmp_path / "gap.npy").iterdir() if f.name.endswith(".npy")]
    np.save(tmp_path / "empty.npy", np.zeros((0, 4)))
    assert arrays.read_array(spark, str(tmp_path / "empty.npy")).count() == 0


def test_workbook_round_trip(spark, tmp_path):
    rows = [("a & <b>", 1, 2.5, None, True), (None, None, None, None, None), (" 2 ", -3, 1e-7, "été", False), ("", 0, 0.1, "x\ty", None)]
    df = spark.createDataFrame(rows, "name string, n int, `v (%)` double, t string, f boolean").coalesce(1)
    workbook.write_workbook(df, f"file://{tmp_path}/w.xlsx")
    got = workbook.read_workbook(spark, f"file://{tmp_path}/w.xlsx")
    assert got.columns == df.columns
    assert [tuple(r) for r in got.collect()] == [("a & <b>", "1", "2.5", None, "true"), (" 2 ", "-3", "1e-07", "été", "false"), ("", "0", "0.1", "x\ty", None)]


def sheet(rows, shared=""):
    """A workbook of two sheets as other programs write them."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{workbook.MAIN}" xmlns:r="{workbook.OFFICE}"><sheets><sheet name="first" sheetId="7" r:id="rId9"/><sheet name="other" sheetId="2" r:id="rId3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbook.PACKAGE}"><Relationship Id="rId3" Target="/xl/worksheets/sheet1.xml"/><Relationship Id="rId9" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{workbook.MAIN}"><sheetData><row><c t="inlineStr"><is><t>only</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{workbook.MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbook.MAIN}">{shared}</sst>')
    return out.getvalue()


def test_cells_of_all_kinds():
    rows = '<row r="2"><c r="B2" t="s"><v>1</v></c><c r="D2"><v>1.50</v></c></row><row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5" t="e"><v>#N/A</v></c><c r="AA5" t="str"><f>1+1</f><v>two</v></c></row><row><c><v>3</v></c></row>'
    content = sheet(rows, "<si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r><rPh><t>not read</t></rPh></si>")
    got = list(workbook.rows_of(content))
    assert got[0] == (2, [None, "one", None, "1.50"])
    assert got[1][0] == 5 and got[1][1][:2] == ["true", None] and got[1][1][26] == "two" and got[2] == (6, ["3"])
    assert list(workbook.rows_of(content, "other")) == [(1, ["only"])]
    assert [workbook.column_of(workbook.name_of(k) + "3") for k in (0, 25, 26, 701, 702, 16383)] == [0, 25, 26, 701, 702, 16383]


def test_sheet_starts_where_it_has_values(spark, tmp_path):
    rows = '<row r="1"><c r="A1" t="inlineStr"><is><t> </t></is></c></row>'.replace(" </t>", "</t>") + '<row r="3"><c r="B3" t="inlineStr"><is><t> x </t></is></c><c r="C3" t="inlineStr"><is><t>y</t></is></c></row><row r="4"><c r="B4"><v>1</v></c></row><row r="6"><c r="A6"><v>9</v></c><c r="C6"><v>2</v></c></row>'
    (tmp_path / "s.xlsx").write_bytes(sheet(rows))
    got = workbook.read_workbook(spark, f"file://{tmp_path}/s.xlsx")
    assert got.columns == ["x", "y"] and [tuple(r) for r in got.collect()] == [("1", None), (None, "2")]
    (tmp_path / "e.xlsx").write_bytes(sheet(""))
    with pytest.raises(ValueError, match="no rows"):
        workbook.read_workbook(spark, f"file://{tmp_path}/e.xlsx")


def test_intake_reads_its_records_once(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 5 == 0).alias("good"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    records = spark.read.parquet(str(tmp_path / "in"))
    spark.sparkContext.setJobGroup("intake", "")
    kept, counters = ingest.intake(records, F.col("good"), "source", f"file://{tmp_path}/out")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("intake")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = [i for i in range(1000) if i % 5 == 0 and i % 7]
    assert sorted(r.id for r in kept.collect()) == want and kept.columns == records.columns
    assert counters == {"scanned": 1000, "kept": len(want), "pass_rate": len(want) / 1000, "distinct_sources": 3}
    assert counters == ingest.funnel(records, F.col("good"), "source").first().asDict()
    assert len(jobs) <= 4  # one writes, the others are the stages that count sources among what was kept
    _, none = ingest.intake(records.limit(0), F.col("good"), "source", f"file://{tmp_path}/none")
    assert none == {"scanned": 0, "kept": 0, "pass_rate": 0.0, "distinct_sources": 0}


def test_plans_as_an_expression(spark):
    plans = [{}, {"nehvi": 4}, {"nehvi": 5, "random": -1}, {"scalarized_0.3_0.7": 2, "parego": 2}, {"teleport": 4}, {"scalarized_x": 4}, {"random": 3}, {"uncertainty": 4, "nehvi": 0}, None, {"nehvi": None}]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(plans)], "id int, plan map<string,int>")
    got = {r.id: r.ok for r in df.select("id", cards.valid_plan(F.col("plan"), 4).alias("ok")).collect()}

    def fits(p):
        try:
            cards.check_plan(p, 4)
        except ValueError:
            return False
        return True

    assert got == {i: fits(p) for i, p in enumerate(plans)}


def test_joint_plot_counts_every_row(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(y)] + [(300, None, 1.0)], "id bigint, y1 double, y2 double")
    rows = stats.joint_plot(df, "y1", "y2", 8).collect()
    want, _, _ = np.histogram2d(y[:, 0], y[:, 1], bins=8)
    for layer, counts in (("cell", want), ("top", want.sum(1)), ("right", want.sum(0))):
        got = {(r.bx, r.by_): r.n for r in rows if r.layer == layer}
        assert sum(got.values()) == 300
        for at, n in np.ndenumerate(counts):
            key = at if layer == "cell" else (at[0], None) if layer == "top" else (None, at[0])
            assert got.get(key, 0) == n
    shown = campaign.objective_space(df.dropna(), [4, 2], (-9.0, -9.0), 8).collect()
    assert {r.layer for r in shown} == {"cell", "top", "right", "front", "initial", "reference", "rho"}
    assert [(r.x, r.y) for r in sorted((r for r in shown if r.layer == "initial"), key=lambda r: r.step)] == [tuple(y[4]), tuple(y[2])]


def test_leaderboard_is_numbered_across_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(f"t{i}", float(rng.integers(0, 4)), float(rng.integers(0, 3)), int(rng.integers(0, 3)), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "team_name string, auc_hv double, final_hv double, n_nondominated_selected int, embedding_diversity double").repartition(5)
    got = [r.team_name for r in campaign.leaderboard(df).collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (-r[1], -r[2], -r[3], -r[4], r[0]))]
