"""The chain of commands over files: reports and answers of two models and two prompts, to metrics and summaries."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from reportloom import cli
from reportloom.operators import answers as A
from reportloom.sources import paths, readers, writers

REPORTS = {"a": "bleed in the frontal lobe", "b": "nothing at all", "c": "blood in the ventricles", "z": "edema"}


def answer_of(model, text):
    report = text.partition("Report:\n")[2]
    if report == REPORTS["a"]:
        # eleven lesions: the tenth and eleventh come after the second
        lines = [f"lesion {k}: type = ICH; size = {k} cm; structure = frontal; lateralization = left;" for k in range(1, 12)]
        return "\n".join(lines if model == "m1" else lines[:1])
    if report == REPORTS["c"] and model == "m1":
        return "lesion 1: type = IVH; structure = third ventricle;\nlesion 2: type = SAH;"
    return "No lesions mentioned."


@pytest.fixture(scope="module")
def endpoint():
    class Handler(BaseHTTPRequestHandler):
        def reply(self, value):
            data = json.dumps(value).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.reply({"data": [{"id": "m1"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body["messages"][-1]["content"])
            self.reply({"choices": [{"message": {"content": answer_of(self.path.split("/")[1] if self.path.startswith("/m2") else "m1", body["messages"][-1]["content"])}}]})

        def log_message(self, *args):
            pass

    seen: list[str] = []
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_chain(spark, tmp_path, endpoint):
    url, seen = endpoint
    root = str(tmp_path)
    (tmp_path / "reports.csv").write_text("ID,Report\n" + "".join(f'{k},"{v}"\n' for k, v in REPORTS.items()))
    (tmp_path / "gt.csv").write_text("ID,all_booleans_false,ivh_presence,ich_localisation,size\nc,False,True,,\nb,True,False,,\na,False,False,frontal,1 cm/2 cm\nz,False,True,temporal,\n")
    (tmp_path / "prompts.json").write_text(json.dumps({"3": {"text": "Our own words."}}))
    for model, base in (("m1", url), ("m2", f"{url}/m2")):
        for prompt in (3, 10) if model == "m1" else (3,):
            own = ["--model", model] if model == "m2" else []
            more = ["--prompts", f"{root}/prompts.json"] if prompt == 3 else None
            if prompt == 10:
                (tmp_path / "ten.json").write_text(json.dumps({"10": {"fields": list(A.PROMPTS[3].fields)}}))
                more = ["--prompts", f"{root}/ten.json"]
            cli.main(["infer", "--input", f"{root}/reports.csv", "--output", f"{root}/o", "--base-url", base, "--prompt-id", str(prompt), *own, *more])
    assert any(x.startswith("Our own words.\n\nReport:") for x in seen) and any("lateralization = _;\n\nReport:" in x for x in seen)
    raw = readers.read_table(spark, f"{root}/o/raw")
    assert {(r["model"], r["prompt_id"], r["count"]) for r in raw.groupBy("model", "prompt_id").count().collect()} == {("m1", "3", 15), ("m1", "10", 15), ("m2", "3", 4)}
    # a run without restart asks and appends again, of its own prompt and model alone
    before = len(seen)
    cli.main(["infer", "--input", f"{root}/reports.csv", "--output", f"{root}/o", "--base-url", f"{url}/m2", "--prompt-id", "3", "--model", "m2", "--restart"])
    assert len(seen) == before + 4 and readers.read_table(spark, f"{root}/o/raw/prompt3").count() == 19

    cli.main(["postprocess", "--input", f"{root}/o/raw", "--output", f"{root}/post"])
    assert (tmp_path / "post/prompt3/results_m2_prompt3_postprocessed.csv").is_dir()
    cli.main(["format", "--input", f"{root}/post", "--output", f"{root}/formatted"])
    rows = {(r["model"], r["prompt_id"], r["ID"], r["type"]): r for r in readers.read_table(spark, f"{root}/formatted").collect()}
    assert set(rows) == {("m1", "3", "a", "ICH"), ("m1", "10", "a", "ICH"), ("m2", "3", "a", "ICH"), ("m1", "3", "c", "IVH"), ("m1", "10", "c", "IVH")}
    assert rows["m1", "3", "a", "ICH"]["size"] == "/".join(f"{k} cm" for k in range(1, 12)) and rows["m1", "3", "a", "ICH"]["count"] == "11"
    assert rows["m2", "3", "a", "ICH"]["size"] == "1 cm"

    for name, table in (("raw", f"{root}/o/raw"), ("post", f"{root}/post"), ("formatted", f"{root}/formatted")):
        cli.main(["score", "--input", table, "--ground-truth", f"{root}/gt.csv", "--output", f"{root}/metrics-{name}", "--ignore-all-false", "--all-modes"])
    found = {n: {str(p.relative_to(tmp_path / f"metrics-{n}")): p.read_text() for p in sorted((tmp_path / f"metrics-{n}").rglob("*.*")) if p.is_file()} for n in ("raw", "post", "formatted")}
    assert found["raw"] == found["post"] == found["formatted"]  # whichever step scoring starts from
    ivh = "prompt3/m2/ivh_presence/metrics_m2_prompt3_ivh_presence_all_false_ignored.csv"
    assert found["raw"][ivh].splitlines()[1].startswith("0,0,2,1,0.0")
    text = found["raw"]["prompt3/m2/ivh_presence/errors_m2_prompt3_ivh_presence_all_false_ignored.txt"]
    assert text.endswith("Errors - false_negative\nID\nc\nz\n")
    assert "gt_coverage=0.500" in found["raw"]["prompt3/m2/ich_size/flexible/errors_m2_prompt3_ich_size_flexible.txt"]

    metrics = f"{root}/metrics-raw"
    written = {p: (tmp_path / f"metrics-raw/prompt{p}/summary_metrics_prompt{p}.csv").read_text() for p in (3, 10)}
    (tmp_path / "metrics-raw/prompt3/m0").mkdir()
    for p in (3, 10):
        cli.main(["summarize", "--metrics-dir", f"{metrics}/prompt{p}"])
    again = {p: (tmp_path / f"metrics-raw/prompt{p}/summary_metrics_prompt{p}.csv").read_text() for p in (3, 10)}
    assert again[10] == written[10]  # what files say is what scoring said
    lines = [x.split(",") for x in again[3].splitlines()]
    assert lines[0] == ["metric", "m0", "m1", "m2"] and all(x[1] == "N/A" for x in lines[1:]) and [",".join([x[0], *x[2:]]) for x in lines] == written[3].splitlines()
    cli.main(["summarize", "--metrics-dir", f"{metrics}/prompt3", "--output", "other.csv"])
    assert (tmp_path / "metrics-raw/prompt3/other.csv").read_text() == again[3]

    cli.main(["prompt-summary", "--metrics-root", metrics, "--output-dir", f"{root}/all", "--all-models"])
    assert [p.name for p in (tmp_path / "all").iterdir()] == ["summary_prompts_m1.csv"]  # m2 has one prompt alone
    lines = [x.split(",") for x in (tmp_path / "all/summary_prompts_m1.csv").read_text().splitlines()]
    assert lines[0] == ["metric", "prompt10", "prompt3"] and lines[3][0] == "ivh_presence_specificity" and len(lines) == 8
    cli.main(["prompt-summary", "--metrics-root", metrics, "--output-dir", f"{root}/all", "--model", "m2"])
    assert {x.split(",")[1] for x in (tmp_path / "all/summary_prompts_m2.csv").read_text().splitlines()[1:]} == {"N/A"}
    for bad in (["prompt-summary", "--metrics-root", metrics, "--output-dir", root], ["prompt-summary", "--metrics-root", f"{root}/post", "--output-dir", root, "--all-models"][:0] or ["summarize", "--metrics-dir", f"{root}/nowhere"]):
        with pytest.raises(ValueError):
            cli.main(bad)


def test_step_switches_and_single_metrics(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "results_m_prompt3.csv").write_text("ID,Lesion Index,type,certainty,size,structure,lateralization\na,1,SAH,c,1,x,U\na,2,ICH,c,2 cm,Frontal lobe,U\na,10,ICH,c,3 cm,U,U\n")
    cli.main(["format", "--input", f"{root}/results_m_prompt3.csv", "--output", f"{root}/f", "--steps", "group"])
    rows = {r["type"]: r for r in readers.read_table(spark, f"{root}/f").collect()}
    assert rows["ICH"]["structure"] == "Frontal lobe/U" and rows["SAH"]["count"] == "1"
    (tmp_path / "gt.csv").write_text("ID,ivh_presence,size\na,True,2 cm/3 cm\n")
    cli.main(["score", "--input", f"{root}/results_m_prompt3.csv", "--ground-truth", f"{root}/gt.csv", "--output", f"{root}/m", "--metrics", "ich_size"])
    assert [p.name for p in (tmp_path / "m/prompt3/m").iterdir()] == ["ich_size"]
    with pytest.raises(ValueError):
        cli.main(["format", "--input", f"{root}/results_m_prompt3.csv", "--output", f"{root}/f", "--steps", "nothing"])


def test_models_without_a_row_left_are_scored(spark, tmp_path):
    (tmp_path / "results_m_prompt3.csv").write_text("ID,Lesion Index,type,size,structure,lateralization\na,0,No lesions mentioned,U,U,U\n")
    (tmp_path / "gt.csv").write_text("ID,ivh_presence\na,True\n")
    cli.main(["score", "--input", f"{tmp_path}/results_m_prompt3.csv", "--ground-truth", f"{tmp_path}/gt.csv", "--output", f"{tmp_path}/m"])
    assert (tmp_path / "m/prompt3/m/ivh_presence/metrics_m_prompt3_ivh_presence.csv").read_text().splitlines()[1].startswith("0,0,1,0")


def test_report_folder_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    both = {"checklist": {"loc_frontal": True, "phe_mild": False}, "measurements": [{"measurements": {"z": {"value": k, "unit": "mm"}}, "control_points": []} for k in range(40, 51)]}
    (tmp_path / "in/r2.json").write_text(json.dumps({"dictation": "b", **both}))
    (tmp_path / "in/r1_report.json").write_text(json.dumps({"dictation": "a"}))  # no checklist: a row of False
    (tmp_path / "in/r3.json").write_text("{oops")
    for name in ("reports", "booleans", "measurements"):
        cli.main([name, "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/{name}"])
    table = lambda name: [r.asDict() for r in readers.read_table(spark, f"{tmp_path}/{name}").drop("file", "prompt_id", "model").collect()]
    assert table("reports") == [{"ID": "r1", "Report": "a"}, {"ID": "r2", "Report": "b"}]
    assert table("booleans") == [{"ID": "r1", "loc_frontal": "False", "phe_mild": "False"}, {"ID": "r2", "loc_frontal": "True", "phe_mild": "False"}]
    assert [r["measurement_index"] for r in table("measurements")] == [*map(str, range(1, 12))]
    cli.main(["ground-truth", "--booleans", f"{tmp_path}/booleans", "--measurements", f"{tmp_path}/measurements", "--output", f"{tmp_path}/gt"])
    gt = {r["ID"]: r for r in table("gt")}
    assert gt["r1"]["all_booleans_false"] == "True" and gt["r1"]["size"] is None and gt["r2"]["size"].startswith("4.0 x 4.1")


def test_folders_and_headers(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "none"))
    (tmp_path / "results_a_prompt1.csv").write_text("ID,type,size\n1,ICH,2\n")
    (tmp_path / "results_b_prompt2.CSV").write_text("type,ID\nIVH,1\n")
    got = sorted((r["model"], r["prompt_id"], r["ID"], r["type"], r["size"]) for r in readers.read_table(spark, str(tmp_path)).collect())
    assert got == [("a", "1", "1", "ICH", "2"), ("b", "2", "1", "IVH", None)]
    named = spark.createDataFrame([("1", "ICH", "a b/c", "7")], "ID string, type string, model string, prompt_id string")
    out = writers.write_results(named, str(tmp_path / "w"), paths.FORMATTED)
    assert out[0].endswith("_prompt7_formated.csv") and [tuple(r)[:4] for r in readers.read_table(spark, str(tmp_path / "w")).select("ID", "type", "model", "prompt_id").collect()] == [("1", "ICH", "a b/c", "7")]
