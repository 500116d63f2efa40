import csv
import io
import random
import zipfile

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from dataquarry.operators import columns as C
from dataquarry.operators.features import build_preprocessor
from dataquarry.sources import checkpoints as K
from dataquarry.sources import tables as S


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_pads_short_rows_and_drops_long_ones(spark, tmp_path):
    f = tmp_path / "messy.csv"
    f.write_text("a;b;c\n1;x;2.5\n2;y\n3;z;4.5;9\nNA;w;1.5\n")
    df = S.read_csv(spark, str(f))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double"]
    assert sorted(rows(df), key=str) == sorted([(1, "x", 2.5), (2, "y", None), (None, "w", 1.5)], key=str)
    # A narrower projection must not change which rows are kept.
    assert S.scan_csv_sniffed(spark, str(f)).select("a").count() == 3


def test_csv_quotes_and_delimiters(spark, tmp_path):
    f = tmp_path / "q.csv"
    f.write_text('name,n\n"a, ""b""",1\nc,2\n')
    assert sorted(rows(S.read_csv(spark, str(f)))) == [('a, "b"', 1), ("c", 2)]
    assert S.sniff_delimiter("a\tb\tc") == "\t"
    assert S.sniff_delimiter("single") == ","


def test_csv_line_breaks_and_repeated_names(spark, tmp_path):
    f = tmp_path / "breaks.csv"
    f.write_text('a,b,a,,a\n1,"x\ny ""z""",2,3,4\n5,"\n",6\n7,8,9,10,11,12\n')
    df = S.read_csv(spark, str(f))
    assert df.columns == ["a", "b", "a.1", "Unnamed: 3", "a.2"]
    assert sorted(rows(df), key=str) == [(1, 'x\ny "z"', 2, 3, 4), (5, "\n", 6, None, None)]
    assert S.header_names(["a", "a", "a.1", "a"]) == ["a", "a.2", "a.1", "a.3"]
    (tmp_path / "plain.csv").write_text("a,b\n1,2\n3,4\n")
    assert sorted(rows(S.read_csv(spark, str(tmp_path / "plain.csv")))) == [(1, 2), (3, 4)]


def test_csv_with_breaks_is_read_in_splits(spark, tmp_path):
    """One file over many splits: records cross borders, some fill several splits, headers have breaks too."""
    rng = random.Random(4)
    pieces = ["plain", 'with ""doubled"" quotes', "break\nin it", "a,comma", "\n\n", "cr\r\nlf", "é" * 40, "x,\n" * 700, '""', '""\n""', "5"]
    files = {}
    for name in ("one", "two"):
        lines = []
        for i in range(400):
            cells = [str(i), *(rng.choice(['"%s"' % rng.choice(pieces), "bare", "", '""', 'stray 5" pipe']) for _ in range(rng.choice([1, 2, 2, 2, 2, 3])))]
            lines.append(",".join(cells))
        end = "\r\n" if name == "two" else "\n"
        files[name] = ('id,"long\nname",c' + end + end.join(lines) + (end if name == "one" else "")).encode()
        (tmp_path / f"{name}.csv").write_bytes(files[name])

    expected = []
    for data in files.values():
        for row in list(csv.reader(io.StringIO(data.decode(), newline="")))[1:]:
            if row and len(row) <= 3:
                expected.append(tuple(c or None for c in row + [""] * (3 - len(row))))
    settings = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "200"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 100
        df = S.scan_csv_sniffed(spark, str(tmp_path))
        assert df.columns == ["id", "long\nname", "c"]
        found = rows(df)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_infer_types_reads_missing_tokens(spark):
    df = spark.createDataFrame([("1", "True", "", "x"), ("NaN", "false", "null", "NA"), ("-3", None, "N/A", "2")], "i string, b string, e string, s string")
    out = S.infer_types(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "boolean", "double", "string"]
    assert rows(out.select("s")) == [("x",), (None,), ("2",)]


def _book(lines):
    sheet = "<worksheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><sheetData>"
    for line in lines:
        sheet += "<row>" + "".join(line) + "</row>"
    shared = "<sst xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><si><t>name</t></si><si><t>n</t></si></sst>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet + "</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", shared)
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    head = ["<c r='A1' t='s'><v>0</v></c>", "<c r='B1' t='s'><v>1</v></c>"]
    one = _book([head, ["<c r='A2' t='inlineStr'><is><t>x</t></is></c>", "<c r='B2'><v>1.5</v></c>"]])
    two = _book([head, ["<c r='B2'><v>2</v></c>"]])
    (tmp_path / "one.xlsx").write_bytes(one)
    (tmp_path / "two.xlsx").write_bytes(two)
    df = S.scan_excel(spark, str(tmp_path))
    assert df.columns == ["name", "n"]
    assert set(rows(df)) == {("x", 1.5), (None, 2.0)}


def test_workbook_order_dates_and_names(spark, tmp_path):
    main = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    office = "xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'"
    text = lambda t: f"<c t='inlineStr'><is><t>{t}</t></is></c>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main} {office}><sheets><sheet name='b' r:id='rId2'/><sheet name='a' r:id='rId1'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>"
                   "<Relationship Id='rId1' Target='worksheets/sheet1.xml'/><Relationship Id='rId2' Target='/xl/worksheets/sheet2.xml'/></Relationships>")
        z.writestr("xl/styles.xml", f"<styleSheet {main}><numFmts><numFmt numFmtId='170' formatCode='dd/mm/yyyy hh:mm'/><numFmt numFmtId='171' formatCode='0.00 &quot;days&quot;'/>"
                   "</numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/><xf numFmtId='170'/><xf numFmtId='171'/></cellXfs></styleSheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData><row>{text('wrong')}</row></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData><row>{text('d')}{text('d')}{text('n')}{text('m')}</row>"
                   f"<row><c s='1'><v>45292</v></c><c s='2'><v>45292.75</v></c><c s='3'><v>1.5</v></c><c s='1'><v>1</v></c></row>"
                   f"<row><c s='1'><v>60.5</v></c><c s='2'/><c><v>2</v></c>{text('x')}</row></sheetData></worksheet>")
    (tmp_path / "b.xlsx").write_bytes(out.getvalue())
    df = S.scan_excel(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("d", "timestamp"), ("d.1", "timestamp"), ("n", "double"), ("m", "string")]
    got = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    assert sorted(rows(got), key=str) == sorted(
        [("2024-01-01 00:00:00", "2024-01-01 18:00:00", "1.5", "1900-01-01 00:00:00"), ("1900-02-28 12:00:00", None, "2.0", "x")], key=str
    )


def test_scan_auto_errors_and_warns(spark, tmp_path, caplog):
    with pytest.raises(FileNotFoundError):
        S.scan_auto(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(ValueError):
        S.scan_auto(spark, str(tmp_path / "x.json"))
    (tmp_path / "X.CSV").write_text("a,b\n1,2\n")
    assert rows(S.scan_auto(spark, str(tmp_path / "X.CSV"), warning_mb=0)) == [(1, 2)]
    assert "above" in caplog.text


def test_nan_is_null(spark, tmp_path):
    p = str(tmp_path / "n.parquet")
    spark.sql("select * from values (1.0D), (double('NaN')), (null) t(x)").write.parquet(p)
    df = S.scan_parquet(spark, p)
    assert df.agg(F.avg("x"), F.count("x")).first() == (1.0, 1)


def test_checkpoints(spark, tmp_path):
    root = str(tmp_path)
    assert K.checkpoint_read(spark, root, "a", "clean") == (None, None)
    K.checkpoint_write(spark.range(3).toDF("x"), root, "a", " Fase 0 Clean", {"route": "fase_1", "nested": {"k": [1, "ñ"]}})
    df, meta = K.checkpoint_read(spark, root, "a", "fase_0_clean")
    assert df.count() == 3 and meta == {"route": "fase_1", "nested": {"k": [1, "ñ"]}}
    assert K.checkpoint_read(spark, root, "a_b", "fase_0_clean") == (None, None)
    with pytest.raises(ValueError):
        K.checkpoint_write(spark.range(1).toDF("x"), root, " ", "p")
    K.checkpoint_write(spark.range(1).toDF("x"), root, "a", "bare")
    assert K.checkpoint_read(spark, root, "a", "bare")[1] is None


def test_saved_model_scores_the_same(spark, tmp_path):
    df = spark.createDataFrame([(float(i), "ab"[i % 2], 3.0 * i + 1) for i in range(20)], "x double, c string, y double")
    prep, names = build_preprocessor(df, ["x"], ["c"])
    assert names == ["num__x", "cat__c_a", "cat__c_b"]
    model = Pipeline(stages=[prep, LinearRegression(featuresCol="features", labelCol="y")]).fit(df)
    path = K.model_save(model, str(tmp_path / "m"))
    before = [r.prediction for r in model.transform(df).collect()]
    assert [r.prediction for r in K.model_load(path).transform(df).collect()] == before


def test_masking_is_idempotent_and_key_based(spark):
    df = spark.createDataFrame([(1,) * 101], ", ".join(f"c{i} int" for i in range(101)))
    masked, names = C.mask_columns(df)
    assert masked.columns[0] == "Var_01" and masked.columns[99] == "Var_100"
    assert C.mask_columns(masked)[0].columns == masked.columns
    assert C.unmask_columns(masked, C.mapping(df)).columns == df.columns
    report = spark.createDataFrame([("Var_10",), ("Var_100",), ("other",)], "feature string")
    assert sorted(rows(C.unmask_values(report, "feature", names))) == [("c9",), ("c99",), ("other",)]
    assert C.resolve(masked, "c9", C.mapping(df)) == "Var_10"
    with pytest.raises(ValueError):
        C.resolve(masked, "nope")
    with pytest.raises(ValueError):
        C.split_features_target(df, "nope")
