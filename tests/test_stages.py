"""Stages on small invented tables, with results worked out by hand."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from reportloom.operators import answers as A
from reportloom.operators import builders as B
from reportloom.operators import formatting as G
from reportloom.operators import scoring as S
from reportloom.operators import summary as M
from reportloom.plans.scoring import Options, score_all, summarize, write_all
from reportloom.sources import paths, readers, writers


def measure(value, unit="mm", points=(), key="z"):
    return {"measurements": {key: {"value": value, "unit": unit}}, "control_points": [{"position_ras": list(p)} for p in points]}


@pytest.fixture(scope="module")
def reports(tmp_path_factory):
    folder = tmp_path_factory.mktemp("reports")
    both = [(1, 2, 3), (4, 5, 6)]
    files = {
        "c1_report.legacy.json": {"dictation": "a", "checklist": {"loc_frontal": True, "ivh_none": True, "phe_mild": False}, "measurements": [measure(43, points=both), measure(20)]},
        "c2_report.json": {"dictation": "", "checklist": {"loc_frontal": True}},
        "c3.json": {"dictation": "b", "checklist": {"loc_frontal": "x", "ivh_none": True}, "measurements": []},
        "c4.json": {"dictation": "c", "checklist": {"loc_frontal": False}, "measurements": {}},
        "c6.json": {"dictation": "d", "measurements": [{"measurements": {"z": {"value": 0, "unit": "mm"}, "a": {"value": 5, "unit": "cm"}}}]},
        "c8.json": {"dictation": "e", "measurements": [measure(1, points=[(1, 2, 3)]), measure(2, points=[(1, "q", 3), (4, 5, 6)])]},
        "c9.json": {"dictation": "f", "measurements": [measure(1), 7, measure(2, unit=5)]},
    }
    for k, (name, content) in enumerate(files.items()):
        (folder / name).write_text(json.dumps(content, indent=2 if k % 2 else None))
    (folder / "c5.json").write_text("{oops")
    (folder / "c7.json").write_text("[1]")
    (folder / "note.txt").write_text("{}")
    return str(folder)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_report_json(spark, reports):
    docs = readers.read_report_json(spark, reports)
    assert readers.count_skipped(spark, reports) == 2
    assert rows(B.build_reports(docs)) == [("c1", "a"), ("c3", "b"), ("c4", "c"), ("c6", "d"), ("c8", "e"), ("c9", "f")]
    booleans = B.build_booleans(docs)  # c2 has no dictation but narrows the keys
    assert booleans.columns == ["ID", "loc_frontal"] and rows(booleans) == [("c1", True), ("c3", False), ("c4", False), ("c6", False), ("c8", False), ("c9", False)]
    got = rows(B.build_measurements(docs), "ID", "measurement_index")
    assert [(r[0], r[1], r[8], r[9]) for r in got] == [
        ("c1", "1", 43.0, "mm"), ("c1", "2", 20.0, "mm"), ("c3", "no_measure", None, None), ("c6", "no_measure", None, None),
        ("c8", "1", 1.0, "mm"), ("c8", "2", 2.0, "mm"), ("c9", "1", 1.0, "mm"), ("c9", "2", 2.0, None),
    ]
    assert got[0][2:8] == (1, 2, 3, 4, 5, 6) and got[4][2:8] == (None,) * 6 and got[5][2:8] == (1, None, 3, 4, 5, 6)


def test_booleans_take_true_alone(spark):
    docs = spark.createDataFrame([("c7", '{"dictation":"d","checklist":{"loc_a":"x","loc_b":1,"loc_c":null}}')], "ID string, value string")
    assert rows(B.build_booleans(docs)) == [("c7", False, False, False)]


def test_ground_truth(spark):
    names = ["ID", "loc_frontal", "loc_temporal", "ivh_third", "ivh_none", "phe_none", "phe_mild"]
    booleans = spark.createDataFrame([("a", True, True, True, True, False, False), ("b", *[False] * 6), ("c", False, False, False, True, False, True)], names)
    measures = spark.createDataFrame([("a", "2", 20.0, "mm", 1), ("a", "1", 40.0, "mm", 2), ("a", "3", 3.0, "cm", 3), ("b", "no_measure", None, None, 4), ("z", "1", 1.0, "cm", 5)], "ID string, measurement_index string, measurement double, unit_measure string, ord int")
    got = {r["ID"]: r for r in B.ground_truth(booleans, measures, order=["ord"]).collect()}
    assert got["a"]["size"] == "4.0 x 2.0 cm/3.0 cm" and got["a"]["ich_localisation"] == "frontal/temporal"
    assert not got["a"]["ivh_presence"] and got["a"]["ivh_location"] == "third"
    assert got["b"]["all_booleans_false"] and got["b"]["size"] is None and got["b"]["ich_localisation"] is None
    assert not got["c"]["all_booleans_false"] and got["c"]["phe_presence"] and got["c"]["phe_intensity"] == "mild"
    assert got["z"]["ich_presence"] is None and got["z"]["size"] == "1.0 cm"
    assert all(r["ich_presence"] for r in B.ground_truth(booleans, all_ich_true=True).collect())
    with pytest.raises(ValueError):
        B.ground_truth()


ANSWERS = [
    ("1", "**lesion 1: type = ICH; size = 4.3 x 2.0 cm; structure = a=b;**", 1, [(1, "ICH", "4.3 x 2.0 cm", "a=b")]),
    ("2", "1. lesion 2: Type = PHE; size = ; type = IVH;", 1, [(1, "IVH", "", "U")]),
    ("3", "lesion 3: type = U; size = 1;", 1, [(0, A.NO_LESION, "U", "U")]),
    ("4", "lesion X: type = _; size = _;", 1, [(1, "_", "_", "U")]),
    ("5", "Lesion report: No lesions mentioned. type = ICH;", 1, [(0, A.NO_LESION, "U", "U")]),
    ("6", "x" * 101 + " no lesions mentioned\nlesion 1: type = ICH;", 1, [(1, "ICH", "U", "U")]),
    ("7", "lesion 1: type = ICH", 1, [(0, A.NO_LESION, "U", "U")]),
    ("8", "\tlesion 1: type = ICH; size = 2;\r\n- lesion 2: type = PHE;\r\n", 1, [(1, "ICH", "2", "U"), (2, "PHE", "U", "U")]),
    ("9", None, 1, [(0, A.NO_LESION, "U", "U")]),
]


def test_answers(spark):
    df = spark.createDataFrame([a[:2] for a in ANSWERS], "ID string, `DNN Answer` string")
    got = A.parse_answers(df, 1).select("ID", "Lesion Index", "type", "size", "structure")
    assert rows(got, "ID", "Lesion Index") == [(i, *x) for i, _, _, want in ANSWERS for x in want]
    one = spark.createDataFrame([("1", "lesion 1: type = IVH; ventricle details = V3;")], "ID string, `DNN Answer` string")
    assert A.parse_answers(one, 1).first()["ventricle_details"] == "V3"
    assert "ventricle_details" not in A.parse_answers(one, 3).columns
    with pytest.raises(ValueError):
        A.parse_answers(one, 9)


def test_providers(spark):
    df = spark.createDataFrame([("1", "r1", 7), ("2", "r2", 8)], "ID string, Report string, extra int")
    told = A.answered(df, 3, lambda: A.RecordedProvider({"r1": "lesion 1: type = ICH;", "r2": "none"}))
    assert rows(A.parse_answers(told, 3).select("ID", "type", "extra")) == [("1", "ICH", 7), ("2", A.NO_LESION, 8)]


def test_streamed_answers(spark, tmp_path):
    from reportloom.streaming.answers import append_lesions, stream_lesions

    spark.createDataFrame([("1", "r", "lesion 1: type = ICH;\nlesion 2: type = PHE;")], "ID string, Report string, `DNN Answer` string").write.parquet(str(tmp_path / "in"))
    append_lesions(stream_lesions(spark, str(tmp_path / "in"), 3), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def lesion_rows(spark):
    data = [("a", 1, "ICH", "c", "4 cm", "frontal", "Left"), ("a", 2, "ICH", "c", None, "Tempor", "U"), ("a", 3, "SAH", "c", "1", "x", "U"), (None, 1, "PHE", "c", "léger", None, None), ("b", 1, "ich", "c", "1", "x", "U")]
    return spark.createDataFrame(data, "ID string, `Lesion Index` int, type string, certainty string, size string, structure string, lateralization string")


def test_formatting(spark):
    got = G.format_rows(lesion_rows(spark), ["Lesion Index"]).select("ID", "type", "size", "structure", "lateralization", "count")
    assert rows(got) == [(None, "PHE", "mild", "U", "U", 1), ("a", "ICH", "4 cm", "frontal/temporal", "Left/U", 2)]


GT = [("1", "False", "True", "frontal/temporal", "mild", "10 mm/14 mm"), ("2", "False", "1.0", "frontal", "mild/severe", "4.3 x 2.0 cm"), ("3", "True", "yes", "frontal", "", "10 mm"), ("4", "False", None, "", None, "10 mm"), ("4", "False", "True", "frontal", "severe", None)]
PRED = [("1", "IVH", None, None, 1), ("1", "ICH", "12 mm/8 mm", "temporal-frontal", 1), ("1", "PHE", "mild/moderate", None, 1), ("2", "ICH", "20 x 43 mm", "U", 1), ("2", "PHE", "mild/severe", None, 1), ("3", "ICH", "15 mm", "frontal/x", 1), ("4", " ivh ", None, None, 1), ("9", "IVH", None, None, 1), (None, "IVH", None, None, 1)]


def tables(spark):
    gt = spark.createDataFrame(GT, "ID string, all_booleans_false string, ivh_presence string, ich_localisation string, phe_intensity string, size string")
    return gt, spark.createDataFrame(PRED, "ID string, type string, size string, structure string, count int")


def test_presence(spark):
    gt, pred = tables(spark)
    got = S.presence_metrics(S.presence_rows(gt, pred, "ivh_presence", "IVH")).first()
    assert tuple(got)[:4] == (2, 1, 1, 1)  # a null truth is false; equal ids count each
    strict = S.presence_metrics(S.presence_rows(gt, pred, "ivh_presence", "IVH", ignore_all_false=True, strip=False)).first()
    assert tuple(strict)[:4] == (1, 0, 1, 2) and strict["sensitivity"] == 0.5 and strict["specificity"] == 1.0
    assert [r["ID"] for r in S.extra_ids(gt, pred, "IVH").collect() if r["ID"]] == ["9"]
    none = S.presence_metrics(S.presence_rows(gt.filter("ID = '2'"), pred, "ivh_presence", "IVH")).first()
    assert none["sensitivity"] == none["f1_score"] == 0.0 and none["accuracy"] == 1.0
    with pytest.raises(ValueError):
        S.presence_rows(gt.drop("ivh_presence"), pred, "ivh_presence", "IVH")


def test_severity(spark):
    got = S.severity_rows(*tables(spark))
    assert rows(got.select("ID", "correct", "several")) == [("1", True, True), ("2", False, True), ("4", False, False)]
    assert tuple(S.severity_metrics(got).first()) == (3, 1, 1 / 3)


def test_locations(spark):
    got = S.location_rows(*tables(spark), "ICH", "ich_location")
    assert tuple(S.strict_metrics(got).first()) == (4, 1, 1, 0.25)
    flexible = S.flexible_metrics(got).first()
    assert flexible["no_detection"] == 1 and flexible["avg_gt_coverage"] == (1 + 0 + 1 + 0) / 4 and flexible["avg_pred_precision"] == (1 + 0 + 0.5) / 4
    text = {r["ID"]: r for r in S.error_rows(got, flexible=True).collect()}
    assert text["4"]["section"] == "no_detection" and text["3"]["extra"] == "x" and text["3"]["scores"] == "gt_coverage=1.000 pred_precision=0.500 jaccard=0.500"


def test_sizes(spark):
    got = S.size_rows(*tables(spark))
    assert rows(got.select("ID", "correct")) == [("1", False), ("2", True), ("3", True), ("4", False)]
    assert tuple(S.strict_metrics(got).first()) == (4, 2, 1, 0.5)
    assert tuple(S.flexible_metrics(got, jaccard=False).first()) == (4, 1, 0.625, 0.625)


def test_prediction_equal_to_truth_is_perfect(spark):
    gt, _ = tables(spark)
    pred = gt.select("ID", F.lit("ICH").alias("type"), "size", F.col("ich_localisation").alias("structure")).filter("size is not null and ich_localisation <> ''")
    gt = gt.join(pred.select("ID"), "ID", "left_semi").filter("size is not null")
    assert S.strict_metrics(S.size_rows(gt, pred)).first()["accuracy"] == 1.0
    assert S.strict_metrics(S.location_rows(gt, pred, "ICH", "ich_location")).first()["accuracy"] == 1.0


def test_many_models_in_one_job_and_files(spark, tmp_path):
    gt, pred = tables(spark)
    formatted = pred.filter("ID is not null").crossJoin(spark.createDataFrame([("m1", "3"), ("m2", "3"), ("m1", "10")], "model string, prompt_id string"))
    formatted = formatted.filter("model = 'm1' or type <> 'IVH'")
    scored = score_all(gt, formatted, Options(ignore_all_false=True))
    assert {(s.metric, s.mode) for s in scored} == {("ivh_presence", ""), ("phe_severity", ""), ("ich_location", "strict"), ("ich_location", "flexible"), ("ich_size", "strict"), ("ich_size", "flexible")}
    assert {r["model"]: r["tp"] for r in scored[0].table.filter("prompt_id = '3'").collect()} == {"m1": 1, "m2": 0}
    write_all(scored, str(tmp_path), True)
    files = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.*"))
    assert "prompt3/m1/ich_size/strict/metrics_m1_prompt3_ich_size_strict.csv" in files and "prompt10/summary_metrics_prompt10.csv" in files
    assert "prompt3/m1/ivh_presence/errors_m1_prompt3_ivh_presence_all_false_ignored.txt" in files
    text = (tmp_path / "prompt3/summary_metrics_prompt3.csv").read_text().splitlines()
    assert text[0] == "metric,m1,m2" and text[1] == "phe_presence_sensitivity,N/A,N/A" and len(text) == 8
    values = summarize(scored)
    assert rows(M.common_names(values)) == [("m1",)]
    got = M.prompt_summary(values, "m1", M.summary_rows(spark))
    assert got.columns == ["metric", "prompt10", "prompt3"] and got.count() == 7


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("001", 'say "x",\nnext', True), ("2", "None", False)], "ID string, Report string, flag boolean")
    folder = str(tmp_path / "prompt4" / "results_m_prompt4")
    writers.write_table(df, folder)
    got = readers.read_table(spark, folder).orderBy("ID")
    assert [tuple(r)[:3] for r in got.select("ID", "Report", "flag").collect()] == [("001", 'say "x",\nnext', "True"), ("2", None, "False")]
    assert {r["prompt_id"] for r in got.collect()} == {"4"}
    writers.write_table(df, folder, mode="append")
    assert readers.read_table(spark, folder).count() == 4
    assert rows(writers.only_new(df, df.filter("ID = '2'")).select("ID")) == [("001",)]


def test_report_sources(spark, tmp_path):
    import pandas as pd
    from pyarrow import feather

    frame = pd.DataFrame({"ID": ["a", "b"], "Report": ["x", None]})
    feather.write_feather(frame, str(tmp_path / "r.feather"))
    frame.to_csv(tmp_path / "r.csv", index=False)
    for name in ("r.feather", "r.csv"):
        assert [r["ID"] for r in readers.load_reports(spark, str(tmp_path / name)).collect()] == ["a"]
    many = pd.DataFrame({"ID": pd.Categorical([f"{i:05d}" for i in range(5000)]), "Report": "r", "at": pd.Timestamp("2024-01-02 03:04:05"), "none": None})
    feather.write_feather(many, str(tmp_path / "many.feather"), chunksize=700)
    got = readers.load_reports(spark, str(tmp_path / "many.feather"))
    assert got.count() == 5000 and got.filter("ID = '04999' and none is null and date_format(at, 'HH:mm') = '03:04'").count() == 1
    feather.write_feather(frame, str(tmp_path / "old.feather"), version=1)
    assert [r["ID"] for r in readers.load_reports(spark, str(tmp_path / "old.feather")).collect()] == ["a"]
    sheet = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = [('A1', 's', 0), ('B1', 's', 1), ('A2', None, "007"), ('B2', 'inlineStr', "x &amp; y"), ('A3', 's', 2), ('C3', 'b', 1)]
    cell = lambda r, t, v: f'<c r="{r}"' + (f' t="{t}"' if t else "") + ">" + (f"<is><t>{v}</t></is>" if t == "inlineStr" else f"<v>{v}</v>") + "</c>"
    rows_xml = "".join(f'<row r="{n}">' + "".join(cell(*c) for c in cells if c[0][1] == str(n)) + "</row>" for n in (1, 2, 3))
    with zipfile.ZipFile(tmp_path / "r.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{sheet}"><si><t>ID</t></si><si><r><t>Rep</t></r><r><t>ort</t></r></si><si><t>b</t></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{sheet}"><sheetData>{rows_xml}</sheetData></worksheet>')
    assert rows(readers.load_reports(spark, str(tmp_path / "r.xlsx"))) == [("007", "x & y")]  # b has no report
    with pytest.raises(ValueError):
        readers.load_reports(spark, "r.txt")
    (tmp_path / "s.nii.gz").write_bytes(b"12")
    assert [r["length"] for r in readers.list_images(spark, str(tmp_path)).collect()] == [2]


def test_path_conventions():
    assert paths.metric_paths("o", "3", "m", "ich_size", "strict", True)[0] == "o/prompt3/m/ich_size/strict/metrics_m_prompt3_ich_size_strict.csv"
    assert paths.postprocessed_path("/r/prompt3/results_m.csv", "o") == "o/prompt3/results_m_postprocessed.csv"
    assert paths.formatted_path("/r/prompt3/results_m_postprocessed.csv", "o") == "o/prompt3/results_m_formated.csv"


def test_error_report_leaves_out_empty_options(spark):
    df = spark.createDataFrame([("a", "x")], "ID string, v string")
    text = writers.error_report("T", {"n": 1}, [("E", "ID\tv", df.collect(), False), ("W", "ID", [], True)])
    assert text == "T\nn=1\n\nE\nID\tv\na\tx\n"
