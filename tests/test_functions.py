"""Expressions against literal rows, one for each rule."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from reportloom.functions import exprs as X
from reportloom.functions import labels as L
from reportloom.functions import rules as R
from reportloom.functions import sizes as Z


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_strip_takes_all_white_space(spark):
    assert column(spark, ["\t a b\r\n", " x ", None], X.strip) == ["a b", "x", None]


def test_bool_rules_differ(spark):
    assert column(spark, ["True", " YES ", "1", "1.0", None, "no"], X.parse_bool) == [True, True, True, False, False, False]
    assert column(spark, [0.0, 2.0, None], lambda c: X.parse_bool_value(c, "number"), "double") == [False, True, True]
    assert column(spark, ["t", None], lambda c: X.parse_bool_value(c, "string")) == [True, False]


def test_na_tokens(spark):
    rows = spark.createDataFrame([("None",), ("N/A",), ("",), ("U",), ("none",)], "v string")
    assert [r[0] for r in X.na_normalize(rows).collect()] == [None, None, None, "U", "none"]


@pytest.mark.parametrize(
    "path, prompt, model",
    [("/x/prompt3/results_m-7B_prompt3_formated.csv", "3", "m-7B"), ("/x/metrics/prompt3", "3", "U"), ("results_abc.csv", "U", "abc.csv"), ("other.csv", "U", "U"), ("/a/results_q_formated", "U", "q")],
)
def test_paths(spark, path, prompt, model):
    from reportloom.sources import paths

    assert column(spark, [path], X.prompt_id_of) == [prompt] == [paths.prompt_id(path)]
    assert column(spark, [path], X.model_of) == [model]
    if path.endswith("metrics/prompt3"):
        assert column(spark, [path], lambda c: X.prompt_id_of(c, trailing=False)) == ["U"]


def test_ids_of_files(spark):
    assert column(spark, ["c1_report.legacy.json", "a_report_report.json", "c2.json"], X.id_of_file) == ["c1", "a_report", "c2"]


def test_ich_structures(spark):
    texts = ["Parieto-occipital", "Occipital and frontal", "Putamen/Lenticular", "Corona radiata", None]
    assert column(spark, texts, R.map_ich_structure) == ["parietal-occipital", "frontal-occipital", "lentiform", "Corona radiata", None]


@pytest.mark.parametrize(
    "structure, side, expected",
    [
        ("Lateral Ventricle/V3/V4", "Bilateral/Median/Median", "lateral_left-lateral_right/third/fourth"),
        ("Lateral Ventricle/Occipital Horn", "Left", "lateral_left/lateral_left"),
        ("Third ventricle", "Median", "third"),
        ("Ventricles", "U", "lateral"),
        ("U", "U", "U"),
        ("lateral", None, "lateral"),
        (None, "Left", None),
    ],
)
def test_ivh_structures(spark, structure, side, expected):
    rows = spark.createDataFrame([(structure, side)], "s string, l string")
    assert rows.select(R.map_ivh_structure(F.col("s"), F.col("l"))).first()[0] == expected


def test_phe_severities_fold_accents(spark):
    assert column(spark, ["Modéré", "Severe to mild", "U", "LÉGER", None], R.map_phe_severity) == ["moderate", "mild-severe", "U", "mild", None]
    texts = ["ŒDÈME", "ﬁn ÅNGSTRÖM", "éa", "नमस्ते", "x" * 50]
    expected = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower() for t in texts]
    assert column(spark, texts, R.fold) == expected


def test_label_lists(spark):
    assert column(spark, ["Frontal/ temporal-frontal", "U", None, "a//-b"], L.label_list) == [["frontal", "temporal"], [], [], ["a", "b"]]
    assert column(spark, ["Mild/mild/ severe", "mild-moderate"], L.severity_list) == [["mild", "mild", "severe"], ["mild-moderate"]]


def test_overlap_of_nothing_is_zero(spark):
    rows = spark.createDataFrame([(["a"], []), ([], []), (["a", "b"], ["a"])], "g array<string>, p array<string>")
    got = [tuple(r[0]) for r in rows.select(L.overlap(F.col("g"), F.col("p"))).collect()]
    assert got == [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.5, 1.0, 0.5)]


@pytest.mark.parametrize(
    "text, sizes",
    [
        ("4.3 x 2.0 cm", [[20.0, 43.0]]), ("20 x 43 mm", [[20.0, 43.0]]), ("4 x 3 x 2 cm", [[30.0, 40.0]]), ("4,3 cm", []), ("max 5 mm", []), ("5 mm", [[5.0]]),
        ("2", [[20.0]]), ("", []), (None, []), ("1 cm/ /2*3 mm", [[10.0], [2.0, 3.0]]), ("none", []),
    ],
)
def test_sizes(spark, text, sizes):
    assert column(spark, [text], Z.parse_sizes) == [sizes]


def first_fit(gt, pred, tolerance=5.0):
    """The rule stated plainly."""
    rest, missing = list(pred), []
    for g in gt:
        hit = next((p for p in rest if len(p) == len(g) and all(abs(a - b) <= tolerance for a, b in zip(g, p, strict=True))), None)
        if hit is None:
            missing.append(g)
        else:
            rest.remove(hit)
    return missing, rest


def test_greedy_match_is_first_fit(spark):
    draw = random.Random(5)
    size = lambda: [float(draw.randint(1, 30)) for _ in range(draw.choice([1, 1, 2]))]
    cases = [([size() for _ in range(draw.randint(0, 5))], [size() for _ in range(draw.randint(0, 5))]) for _ in range(80)]
    cases += [([[10.0], [14.0]], [[12.0], [8.0]]), ([[10.0]], [[15.0]]), ([[10.0]], [[10.0, 10.0]])]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, g {Z.SIZES}, p {Z.SIZES}")
    got = [(r[0]["missing"], r[0]["remaining"]) for r in rows.orderBy("i").select(Z.greedy_match(F.col("g"), F.col("p"))).collect()]
    assert got == [first_fit(*c) for c in cases]


def test_units_and_pairs(spark):
    rows = spark.createDataFrame([(40.0, "mm"), (3.0, " CM "), (None, None)], "v double, u string")
    assert [r[0] for r in rows.select(Z.to_cm(F.col("v"), F.col("u"))).collect()] == [4.0, 3.0, None]
    for bad in ("inch", None):
        with pytest.raises(Exception, match="unit"):
            spark.createDataFrame([(1.0, bad)], "v double, u string").select(Z.to_cm(F.col("v"), F.col("u"))).collect()
    assert column(spark, [[4.0, 2.0, 3.0], [], [1.5]], Z.pair_text, "array<double>") == ["4.0 x 2.0 cm/3.0 cm", None, "1.5 cm"]
    assert column(spark, [[4.0], [4.0, 5.26]], Z.size_text, "array<double>") == ["4.0mm", "4.0x5.3mm"]


def test_doubles_keep_their_digits(spark):
    duckdb = pytest.importorskip("duckdb")
    values = [0.0, 0.001, 9999999.5, 1e7, 12000000.5, -1.5e7, 123456789012345.67, 1e15, 1e16, 1.25e17]
    assert column(spark, values, Z.plain_text, "double") == [duckdb.execute("SELECT ?::DOUBLE::VARCHAR", [v]).fetchone()[0] for v in values]
    assert column(spark, [[1.2e7, 3.0]], Z.pair_text, "array<double>") == ["12000000.0 x 3.0 cm"]


def test_size_parse_of_large_keys(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from reportloom.plans.oracles import ORACLE_SQL
    from reportloom.plans.queries import QUERIES

    spark.sql("SELECT id + 1199990 AS p_partkey, cast(id % 50 + 1 AS int) AS p_size FROM range(40)").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["size_parse"](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLE_SQL["size_parse"]).fetchall())


def test_strip_equals_its_pattern(spark):
    texts = [x for c in map(chr, range(1, 0x3100)) for x in (f"{c}a{c}b{c}{c}", c)]
    pattern = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    assert column(spark, texts, X.strip) == column(spark, texts, lambda v: F.regexp_replace(v, pattern, ""))
