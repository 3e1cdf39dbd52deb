"""All scores at once against the scores one by one, reports written by tasks, and metrics that follow a stream."""

import random

import pytest
from pyspark.sql import functions as F

from reportloom.operators import formatting as G
from reportloom.operators import scorecard as C
from reportloom.operators import scoring as S
from reportloom.operators.answers import parse_answers
from reportloom.plans import scoring as P
from reportloom.plans.scoring import BY, Options, score_all, write_all
from reportloom.sources import store
from reportloom.streaming import metrics as live

GT = "ID string, all_booleans_false string, ivh_presence string, phe_presence string, phe_intensity string, ich_location string, ivh_location string, size string"
PRED = "ID string, type string, size string, structure string, model string, prompt_id string, at int"
SIZES = ["10 mm", "14 mm", "1.2 cm", "4 x 2 cm", "", "U", "x", "3cm/5 mm"]


def drawn(seed, n=60):
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    sev = ("mild", "Moderate ", "severe", "", None, "mild/severe")
    places = ("frontal", "frontal/temporal", "U", "", None, "a-b/c", "temporal-frontal")
    gt = [(some(None, *map(str, range(n // 2))), some("True", "False", None, " yes"), some("True", "0", None), some("1", "no"), some(*sev), some(*places), some(*places), some(None, "/".join(rng.choices(SIZES, k=rng.randint(1, 3))))) for _ in range(n)]
    pred = [(some(None, *map(str, range(n // 2 + 8))), some("ICH", "ich ", "IVH", " ivh", "PHE", "phe", "SAH", None), some(*sev, *SIZES), some(*places), some("m1", "m2", "a,b/c"), some("3", "10"), k) for k in range(3 * n)]
    return gt, pred


def same(got, want, key=None):
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    plain = lambda v: round(v, 9) if isinstance(v, float) else str(v)
    rows = lambda df: sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    assert rows(got) == rows(want)


def one_by_one(gt, pred, ign, by, order=()):
    """(metric, mode): table and errors, each by its own joins."""
    out = {}
    for kind, strip in (("IVH", False), ("PHE", True)):
        truth = f"{kind.lower()}_presence"
        rows = S.presence_rows(gt, pred, truth, kind, by, ign, strip)
        extra = S.extra_ids(gt, pred, kind, by, ign, strip).filter("ID is not null").withColumn("section", F.lit("extra"))
        out[truth, ""] = S.presence_metrics(rows, by), S.presence_errors(rows, by).unionByName(extra.select(*by, "section", "ID"))
    rows = S.severity_rows(gt, pred, by, ign, order)
    out["phe_severity", ""] = S.severity_metrics(rows, by), S.error_rows(rows, by)
    for kind in ("ICH", "IVH"):
        rows = S.location_rows(gt, pred, kind, f"{kind.lower()}_location", by, ign, order)
        out[f"{kind.lower()}_location", "strict"] = S.strict_metrics(rows, by), S.error_rows(rows, by)
        out[f"{kind.lower()}_location", "flexible"] = S.flexible_metrics(rows, by), S.error_rows(rows, by, True)
    rows = S.size_rows(gt, pred, by=by, order=order)
    out["ich_size", "strict"] = S.strict_metrics(rows, by), S.error_rows(rows, by)
    out["ich_size", "flexible"] = S.flexible_metrics(rows, by, jaccard=False), S.error_rows(rows, by, True)
    return out


@pytest.mark.parametrize("ign", [True, False])
def test_all_at_once_equals_one_by_one(spark, ign):
    gt, pred = drawn(4 + ign)
    gt, pred = spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED)
    scored = score_all(gt, pred, Options(ign, order=("at",)))
    want = one_by_one(gt, pred, ign, BY, ("at",))
    assert {(s.metric, s.mode) for s in scored} == set(want)
    for s in scored:
        table, errors = want[s.metric, s.mode]
        same(s.table, table)
        same(s.errors, errors)
    lines = C.error_lines(scored.wide, [(s.source, s.mode) for s in scored], BY)
    for s in scored:  # lines of reports say what the rows say
        cells = [c for c in s.errors.columns if c not in (*BY, "section")]
        said = s.errors.select(*BY, "section", F.concat_ws("\t", *(F.coalesce(F.col(c), F.lit("")) for c in cells)).alias("line"))
        same(lines.filter((F.col("metric") == s.metric) & (F.col("mode") == s.mode)).select(*BY, "section", "line"), said)


def test_one_exchange_of_predictions(spark, tmp_path):
    gt, pred = drawn(1)
    spark.createDataFrame(gt, GT).write.parquet(str(tmp_path / "gt"))
    spark.createDataFrame(pred, PRED).write.parquet(str(tmp_path / "pred"))
    names = spark.createDataFrame([("m1", "3")], "model string, prompt_id string")
    found = C.gathered_all(spark.read.parquet(str(tmp_path / "pred")), C.metrics_for(spark.read.parquet(str(tmp_path / "gt"))), BY)
    wide = C.wide_rows(spark.read.parquet(str(tmp_path / "gt")), found, names, list(C.METRICS), BY, False)
    plan = C.tallies(wide, list(C.METRICS), BY)._jdf.queryExecution().executedPlan().toString()
    scans = plan.count("FileScan parquet")
    assert scans == 2  # the predictions and the ground truth, once each
    assert plan.count("Exchange hashpartitioning(model#") == 3  # predictions, ground truth, sums


def test_empty_tables(spark):
    gt, pred = drawn(2)
    gt, pred = spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED)
    names = spark.createDataFrame([("m", "1")], "model string, prompt_id string")
    none = score_all(gt, pred.limit(0), Options(False), names=names)
    got = {(s.metric, s.mode): s.table.first() for s in none}
    assert got["ich_size", "strict"]["correct"] == 0 and got["ich_size", "strict"]["no_detection"] == got["ich_size", "strict"]["total"] > 0
    assert all(s.table.count() == 0 for s in score_all(gt.limit(0), pred, Options(False)))
    assert score_all(gt.select("ID"), pred, Options(False)) == []
    assert C.wide_rows(gt.limit(0), C.gathered_all(pred, list(C.METRICS), ()), None, list(C.METRICS), ()).filter("in_gt").count() == 0


def test_reports_are_files_or_folders(spark, tmp_path):
    gt, pred = drawn(3)
    gt, pred = spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED).withColumn("model", F.concat("model", F.lit("=é %")))
    scored = score_all(gt, pred.filter("not contains(model, '/')"), Options(True, order=("at",)))
    order = P.ground_truth_order(gt)
    told = {}
    for name, most in (("files", 1 << 20), ("folders", 0), ("folders", 1 << 20), ("folders", 0)):  # one takes the other's place
        write_all(scored, f"file://{tmp_path}/{name}", True, order, most)
        reports = sorted(p for p in (tmp_path / name).rglob("errors_*.txt"))
        assert all(p.is_file() == (most > 0) for p in reports) and len(reports) == 9 * 4
        text = {p.name: p.read_text() if p.is_file() else "".join(q.read_text() for q in sorted(p.iterdir())) for p in reports}
        assert told.setdefault("all", text) == text
        assert not [p for p in (tmp_path / name).rglob("_*")]
    text = told["all"]["errors_m1=é %_prompt3_ivh_presence_all_false_ignored.txt"]
    place = {r["ID"]: r["at"] for r in order.collect()}
    sections = {b.split("\n")[0]: b.strip("\n").split("\n")[2:] for b in text.split("\n\n")[1:]}
    assert sections and text.startswith("IVH presence errors\ntp=")
    for ids in sections.values():
        assert ids == sorted(ids, key=lambda i: (place.get(i or None, 1 << 60), i))


def test_metrics_follow_a_stream(spark, tmp_path):
    gt = spark.createDataFrame(drawn(6, 40)[0], GT)
    gt.write.parquet(str(tmp_path / "gt"))
    rng = random.Random(9)
    line = lambda k: f"lesion {k}: type = {rng.choice(['ICH', 'IVH', 'PHE', 'SAH'])}; size = {rng.choice(['10 mm', '1.2 cm', 'minime', 'U', 'severe'])}; structure = {rng.choice(['frontal', 'temporal lobe', 'v3', 'U'])}; lateralization = {rng.choice(['left', 'U'])};"
    answers = [(str(i), m, p, "No lesions mentioned" if rng.random() < 0.2 else "\n".join(line(k) for k in range(rng.randint(1, 5)))) for i in range(30) for m in ("m1", "m2") for p in ("3", "4") if rng.random() < 0.8]
    rng.shuffle(answers)
    answers += [(None, "m1", "3", line(1)), ("1", None, "3", line(1))]
    names = spark.createDataFrame([("m1", "3"), ("m2", "3"), ("m1", "4"), ("m2", "4")], "model string, prompt_id string")
    truth = lambda session: session.read.parquet(str(tmp_path / "gt"))
    options = Options(True)

    def arrive(some):
        for k in range(0, len(some), 40):
            spark.createDataFrame(some[k : k + 40], live.ANSWERS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.follow(live.stream_answers(spark, str(tmp_path / "in"), files=2), truth, str(tmp_path / "sums"), str(tmp_path / "log"), options).awaitTermination()

    def batch(some):
        df = spark.createDataFrame(some, live.ANSWERS).dropna()
        rows = [parse_answers(df.filter(F.col("prompt_id") == p), int(p)) for p in ("3", "4")]
        cols = ["ID", *BY, "Lesion Index", "type", "size", "structure", "lateralization"]
        rows = [r.select(*(c if c in r.columns else F.lit("U").alias(c) for c in cols)) for r in rows]
        formatted = G.format_rows(rows[0].unionByName(rows[1]), ["Lesion Index"], by=("ID", "type", *BY))
        return score_all(gt, formatted, options, names=names)

    spark.createDataFrame([], live.ANSWERS).write.parquet(str(tmp_path / "in"))
    before = live.metrics_so_far(spark, str(tmp_path / "sums"), gt, names, options)
    assert all(r["tp"] == 0 for r in before["ivh_presence", ""].collect())
    half = len(answers) // 2
    arrive(answers[:half])
    now = live.metrics_so_far(spark, str(tmp_path / "sums"), gt, names, options)
    for s in batch(answers[:half]):
        same(now[s.metric, s.mode], s.table)
    arrive(answers[half:] + answers[:20])  # taken up again; repeated answers come too
    assert len([n for _, n, folder in store.children(spark, str(tmp_path / "sums")) if folder and n.startswith("batch=")]) >= 2
    now = live.metrics_so_far(spark, str(tmp_path / "sums"), gt, names, options)
    for s in batch(answers):
        same(now[s.metric, s.mode], s.table)
