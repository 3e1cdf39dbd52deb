"""What survives failures: the ledger of model calls, tables that replace others, files by URI; and tables of many headers."""

import csv
import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from reportloom import cli
from reportloom.operators import answers as A
from reportloom.operators import inference as I
from reportloom.plans.summaries import summarize_folder, summarize_prompts
from reportloom.sources import readers, store, writers

FAST = I.Retry(attempts=2, first=0.01, give_up=2)


class Endpoint:
    """A chat endpoint; ``rule`` (place of the call, report) gives the status of a reply."""

    def __init__(self):
        self.seen, self.rule, self.at_once, self.most, self.lock = [], lambda n, text: 200, 0, 0, threading.Lock()
        own = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                self.put(200, {"data": [{"id": "m"}]})

            def do_POST(self):
                text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][-1]["content"].partition("Report:\n")[2]
                with own.lock:
                    own.at_once += 1
                    own.most = max(own.most, own.at_once)
                    status = own.rule(len(own.seen), text)
                    own.seen.append((text, status))
                time.sleep(0.01)
                with own.lock:
                    own.at_once -= 1
                self.put(status, {"choices": [{"message": {"content": f"lesion 1: type = ICH; structure = {text};"}}]})

            def put(self, status, value):
                self.send_response(status)
                self.end_headers()
                self.wfile.write(json.dumps(value).encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def told(self):
        """Reports that got an answer."""
        return [t for t, status in self.seen if status == 200]


@pytest.fixture
def endpoint():
    made = Endpoint()
    yield made
    made.server.shutdown()


def reports(spark, n):
    return spark.createDataFrame([(str(k), f"r{k}", k) for k in range(n)], "ID string, Report string, extra int")


def test_answers_before_a_failing_endpoint_are_kept(spark, tmp_path, endpoint):
    url, ledger = endpoint.url, f"file://{tmp_path}/answers/prompt_id=3/model=m"
    endpoint.rule = lambda n, text: 200 if n < 50 else 500
    with pytest.raises(I.Unanswered, match="50 reports"):
        I.ask(reports(spark, 100), 3, lambda: A.HttpProvider(url), ledger, calls=3, tasks=2, wave=30, retry=FAST)
    assert len(endpoint.told()) == 50 and endpoint.most <= 6
    assert len(endpoint.seen) <= 50 + 2 * 2 * (FAST.give_up + 3)  # it isn't asked on and on
    first, endpoint.seen, endpoint.rule = set(endpoint.told()), [], lambda n, text: 200
    got = I.ask(reports(spark, 100), 3, lambda: A.HttpProvider(url), ledger, calls=3, tasks=2, wave=30, retry=FAST).collect()
    assert len(endpoint.seen) == 50 and not first & set(endpoint.told())
    assert sorted(int(r["ID"]) for r in got) == list(range(100)) and all(r["DNN Answer"].endswith(f"r{r['ID']};") and r["extra"] == int(r["ID"]) for r in got)
    endpoint.seen = []
    assert I.ask(reports(spark, 100), 3, lambda: A.HttpProvider(url), ledger, retry=FAST).count() == 100 and not endpoint.seen


def test_a_dying_job_costs_its_wave_alone(spark, tmp_path, endpoint):
    url, ledger = endpoint.url, f"{tmp_path}/ledger"

    class Dying:
        def __init__(self, poison):
            self.poison, self.plain = poison, A.HttpProvider(url)

        def __call__(self, talk):
            if self.poison and talk[-1]["content"].endswith(self.poison):
                os._exit(3)
            return self.plain(talk)

    waves = {r["ID"]: r["w"] for r in reports(spark, 60).select("ID", F.pmod(F.xxhash64("ID", F.sha2("Report", 256)), F.lit(10)).alias("w")).collect()}
    for wave in (0, 7):  # a death in the first wave leaves nothing, and one in a later wave those before it
        poison = next(k for k, w in waves.items() if w == wave)
        with pytest.raises(Exception, match="(?i)worker|task"):
            I.ask(reports(spark, 60), 3, lambda poison=poison: Dying(f"r{poison}"), f"{ledger}{wave}", tasks=1, wave=6, retry=FAST)
        assert not [p for p in os.listdir(tmp_path) if p.startswith("_pending")]
        rows = I.read_ledger(spark, f"{ledger}{wave}")
        kept = set() if rows is None else {r["ID"] for r in rows.collect()}
        assert kept == {k for k, w in waves.items() if w < wave}
    ledger = f"{ledger}7"
    endpoint.seen = []
    got = I.ask(reports(spark, 60), 3, lambda: Dying(""), ledger, tasks=1, wave=6, retry=FAST)
    assert got.count() == 60 and len(endpoint.seen) == 60 - len(kept)


def test_passing_errors_are_tried_again_and_others_are_not(spark, tmp_path, endpoint):
    url = endpoint.url
    again = set()

    def rule(n, text):
        if text == "r3":
            return 400
        return 200 if text in again or again.add(text) else 503

    endpoint.rule = rule
    with pytest.raises(I.Unanswered, match="1 reports.*400"):
        I.ask(reports(spark, 9), 3, lambda: A.HttpProvider(url), f"{tmp_path}/l", tasks=1, calls=1, retry=I.Retry(attempts=3, first=0.01, give_up=5))
    rows = spark.read.parquet(f"{tmp_path}/l").collect()
    assert {r["ID"]: (r["_tries"], r["_error"] is None) for r in rows} == {str(k): (1, False) if k == 3 else (2, True) for k in range(9)}
    assert 0.25 <= I.Retry(first=0.5).wait(0, OSError()) <= 0.5 and I.Retry(longest=3).wait(9, OSError()) <= 3


def test_requests_are_told_apart_by_id_and_text(spark, tmp_path, endpoint):
    url, ledger = endpoint.url, f"{tmp_path}/l"
    rows = spark.createDataFrame([("1", "a", 0), ("1", "a", 0), ("1", "b", 0), (None, "c", 0), ("2", None, 0)], "ID string, Report string, extra int")
    assert I.ask(rows, 3, lambda: A.HttpProvider(url), ledger, retry=FAST).count() == 2 and sorted(endpoint.told()) == ["a", "b"]
    assert I.ask(rows.limit(0), 3, lambda: A.HttpProvider(url), ledger, retry=FAST).count() == 2
    changed = spark.createDataFrame([("1", "new", 0)], rows.schema)
    assert I.ask(changed, 3, lambda: A.HttpProvider(url), ledger, retry=FAST).count() == 3 and len(endpoint.seen) == 3


def test_infer_command_is_taken_up_again(spark, tmp_path, endpoint):
    (tmp_path / "r.csv").write_text("ID,Report\n" + "".join(f"{k:03},r{k}\n" for k in range(20)))
    asked = ["infer", "--input", f"{tmp_path}/r.csv", "--output", f"file://{tmp_path}/o", "--base-url", endpoint.url, "--prompt-id", "3", "--model", "a/b,c", "--attempts", "1", "--calls", "2", "--tasks", "1", "--wait", "0.01"]
    endpoint.rule = lambda n, text: 200 if n < 8 else 503
    with pytest.raises(I.Unanswered):
        cli.main(asked)
    assert readers.read_table(spark, f"{tmp_path}/o/raw").count() == 8  # what there is can be worked with
    endpoint.rule = lambda n, text: 200
    before = len(endpoint.seen)
    cli.main(asked)
    got = readers.read_table(spark, f"{tmp_path}/o/raw").collect()
    assert len(endpoint.seen) == before + 12 and sorted(r["ID"] for r in got) == [f"{k:03}" for k in range(20)] and {r["model"] for r in got} == {"a/b,c"}


def test_prompts_name_what_answers_may_hold():
    for k, prompt in A.PROMPTS.items():
        assert all(f in prompt.asked for f in prompt.fields), k
        assert k == 5 or all(t in prompt.asked for t in ("ICH", "IVH", "PHE", "U", A.NO_LESION)), k
    for k in (1, 2, 3):
        assert all(x in A.PROMPTS[k].asked for x in ("cm or mm", "certain", "Bilateral", "severe".title()))


def test_a_failing_job_leaves_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/t.csv"
    writers.write_table(spark.createDataFrame([("1", True)], "ID string, x boolean"), path)
    bad = spark.range(3).select(F.col("id").cast("string").alias("ID"), F.when(F.col("id") == 2, F.raise_error(F.lit("no")).cast("string")).alias("x"))
    with pytest.raises(Exception, match="no"):
        writers.write_table(bad, path)
    assert [(r["ID"], r["x"]) for r in readers.read_table(spark, path).collect()] == [("1", "True")] and os.listdir(tmp_path) == ["t.csv"]
    named = lambda v: spark.createDataFrame([("1", v, "m", "3")], "ID string, type string, model string, prompt_id string")
    writers.write_results(named("ICH"), f"file://{tmp_path}/r", "")
    with pytest.raises(Exception, match="no"):
        writers.write_results(named("IVH").withColumn("type", F.raise_error(F.lit("no")).cast("string")), f"file://{tmp_path}/r", "")
    assert [r["type"] for r in readers.read_table(spark, f"{tmp_path}/r").collect()] == ["ICH"]
    writers.write_results(named("IVH"), f"file://{tmp_path}/r", "")
    assert [r["type"] for r in readers.read_table(spark, f"{tmp_path}/r").collect()] == ["IVH"]


def test_a_table_moved_away_by_a_dead_run_comes_back(spark, tmp_path):
    path = f"{tmp_path}/t.csv"
    writers.write_table(spark.createDataFrame([("1",)], "ID string"), path)
    os.rename(path, store.beside(path, "old"))
    store.recover(spark, path)
    assert readers.read_table(spark, path).first()["ID"] == "1"
    os.rename(path, store.beside(path, "old"))
    writers.write_table(spark.createDataFrame([("2",)], "ID string"), path)
    assert [r["ID"] for r in readers.read_table(spark, path).collect()] == ["2"] and os.listdir(tmp_path) == ["t.csv"]


def test_texts_are_published_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/a/b/é.txt"
    for text in ("", "x\ny é\n", "z" * (3 << 20)):
        store.write_text(spark, path, text)
        assert store.read_text(spark, path) == text
    assert [p.name for p in (tmp_path / "a/b").iterdir()] == ["é.txt"]
    (tmp_path / "a/c").mkdir()
    (tmp_path / "a/c/inside").write_text("")
    with pytest.raises(Exception):
        store.write_text(spark, f"file://{tmp_path}/a/c", "x")
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["b", "c"]


def test_many_files_of_three_headers_are_three_scans(spark, tmp_path):
    heads = ["ID,type,size", "type,ID", '"ID","a ""quoted""\nname",type']
    for k in range(120):
        row = {0: f"{k},ICH,2", 1: f"IVH,{k}", 2: f"{k},x,PHE"}[k % 3]
        (tmp_path / f"results_m{k}_prompt1.csv").write_text(f"{heads[k % 3]}\n{row}\n")
    spark.sparkContext.setJobGroup("scan", "scan")
    try:
        got = readers.read_table(spark, f"file://{tmp_path}")
        rows = got.collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("scan"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 8 and got._jdf.queryExecution().analyzed().toString().count("Relation [") == 3
    assert {(int(r["ID"]), r["type"], r["model"]) for r in rows} == {(k, ("ICH", "IVH", "PHE")[k % 3], f"m{k}") for k in range(120)}
    assert {r['a "quoted"\nname'] for r in rows} == {None, "x"}


def test_skipped_files_are_counted_in_the_same_pass(spark, tmp_path):
    for k, text in enumerate(['{"dictation": "a"}', "[1]", "{oops", '{"dictation": "b"}']):
        (tmp_path / f"r{k}.json").write_text(text)
    seen = Observation("seen")
    assert readers.read_report_json(spark, str(tmp_path), seen).count() == 2
    assert seen.get == {"files": 4, "skipped": 2} and readers.count_skipped(spark, str(tmp_path)) == 2


def test_summaries_of_models_with_commas_and_quotes_by_uri(spark, tmp_path):
    root, models = f"file://{tmp_path}/m", ["a,b", 'say "x"', "plain", "with space"]
    for p in (1, 2):
        for k, m in enumerate(models):
            folder = f"{root}/prompt{p}/{m}/ivh_presence"
            writers.write_rows(spark, f"{folder}/metrics_{m}_prompt{p}_ivh_presence_all_false_ignored.csv", ["tp", "sensitivity", "specificity"], [[1, 0.25 * k, p]])
        path = summarize_folder(spark, f"{root}/prompt{p}")
        table = list(csv.reader(store.read_text(spark, path).splitlines()))
        assert table[0] == ["metric", *sorted(models)]
        found = dict(zip(table[0], next(r for r in table if "sensitivity" in r[0] and "ivh_presence" in r[0]), strict=True))
        assert {m: found[m] for m in models} == {m: str(0.25 * k) for k, m in enumerate(models)}
    out = summarize_prompts(spark, root, f"file://{tmp_path}/all", all_models=True)
    assert [o.rpartition("/")[2] for o in out] == [f"summary_prompts_{m}.csv" for m in sorted(models)]
    table = list(csv.reader(store.read_text(spark, out[0]).splitlines()))
    assert table[0] == ["metric", "prompt1", "prompt2"] and ["ivh_presence_specificity", "1", "2"] in table
