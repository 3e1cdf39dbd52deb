"""Registered queries: the engine's stages over the driver's tables.

The tables hold no reports, so each query first projects one into the shape that a stage takes (ids, types, phrases, sizes),
by expressions alone, and then runs the stage itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import labels as L
from ..functions import rules as R
from ..functions import sizes as Z
from ..operators import answers as A
from ..operators import builders as B
from ..operators import formatting as G
from ..operators import scorecard as C
from ..operators import scoring as S
from ..operators import summary as M
from ..session import importable, spread
from . import samples as P


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(texts: list[str], at: Column) -> Column:
    """The text at a number modulo their count."""
    return F.element_at(F.array(*map(F.lit, texts)), F.pmod(at, F.lit(len(texts))).cast("int") + 1)


# presence: labels are the ground truth, documents with a word are the predictions


def _truth(spark, sf):
    x = read(spark, sf, "labels")
    return x.select(F.col("doc_id").alias("ID"), F.col("toxic").cast("string").alias("ivh_presence"), (F.col("quality") == 0).alias("all_booleans_false"))


def _hits(spark, sf):
    x = read(spark, sf, "documents").filter(F.contains(F.lower("text"), F.lit("trash")) | F.contains("text", F.lit("scum")))
    return x.select(F.col("doc_id").alias("ID"), pick(P.IVH_NAMES, F.col("doc_id")).alias("type"))


def presence_confusion(spark, sf):
    return S.presence_metrics(S.presence_rows(_truth(spark, sf), _hits(spark, sf), "ivh_presence", "IVH"))


def presence_ignore_filter(spark, sf):
    return S.presence_metrics(S.presence_rows(_truth(spark, sf), _hits(spark, sf), "ivh_presence", "IVH", ignore_all_false=True))


def presence_error_ids(spark, sf):
    return S.presence_errors(S.presence_rows(_truth(spark, sf), _hits(spark, sf), "ivh_presence", "IVH"))


def extra_pred_ids(spark, sf):
    return S.extra_ids(_truth(spark, sf), _hits(spark, sf), "IVH", ignore_all_false=True)


def presence_by_source(spark, sf):
    """Many models in one job: a document's source stands for the model."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("ID"), F.col("source").alias("model"))
    hits = _hits(spark, sf).join(docs, "ID")
    return S.presence_metrics(S.presence_rows(_truth(spark, sf), hits, "ivh_presence", "IVH", ("model",)), ("model",))


# grouping and mapping


def group_concat_by_type(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("ID"), F.col("o_orderstatus").alias("type"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("size"), "o_orderkey")
    return G.group_by_lesion_type(rows, ["o_orderkey"])


def type_filter(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", pick(P.TYPE_NAMES, F.col("p_partkey")).alias("type"))
    loose = rows.select(F.count_if(G.of_type("ICH", strip=False)).alias("n_upper"), F.count_if(G.of_type("ICH")).alias("n_stripped"))
    return G.keep_types(rows).groupBy("type").agg(F.count("*").alias("n")).crossJoin(loose)


def keyword_map(spark, sf):
    return read(spark, sf, "documents").select("doc_id", R.keyword_map(F.col("text"), P.SYLLABLES).alias("mapped"))


def ich_structure_map(spark, sf):
    return read(spark, sf, "part").select("p_partkey", R.map_ich_structure(pick(P.ICH_PHRASES, F.col("p_partkey"))).alias("structure"))


def ivh_structure_map(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select("p_partkey", R.map_ivh_structure(pick(P.IVH_PHRASES, k), pick(P.SIDES, F.floor(k / 3))).alias("structure"))


def phe_severity_map(spark, sf):
    return read(spark, sf, "part").select("p_partkey", R.map_phe_severity(pick(P.PHE_PHRASES, F.col("p_partkey"))).alias("size"))


def accent_fold_map(spark, sf):
    x = read(spark, sf, "documents")
    return x.select("doc_id", R.keyword_map(F.col("text"), P.FOLDED_SYLLABLES, R.fold(F.col("text"))).alias("mapped"), F.md5(R.fold(F.col("text"))).alias("folded_md5"))


def format_all(spark, sf):
    """The whole formatting step: filter, the three mappings, grouping."""
    k = F.col("p_partkey")
    raw = read(spark, sf, "part").select(
        F.floor(k / 5).alias("ID"), k.alias("Lesion Index"), pick(P.TYPE_NAMES, k).alias("type"), pick(P.ICH_PHRASES, k).alias("structure"), pick(P.SIDES, k).alias("lateralization"),
        pick(P.PHE_PHRASES, k).alias("size"), F.lit("c").alias("certainty"), F.lit("x").alias("Report"),
    )
    return G.format_rows(raw, ["Lesion Index"])


# label sets: a user's event types, told apart by day, of the mornings against those of the afternoons


def _location_rows(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    label = F.concat(F.lower("event_type"), (F.floor(micros / F.lit(86_400_000_000)) % 2).cast("string"))
    events = read(spark, sf, "events").select("user_id", label.alias("label"), (F.floor(micros / F.lit(3_600_000_000)) % 24 < 12).alias("morning"))
    per = lambda rows, sep: rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("label")), sep).alias("v"))
    gt = per(events.filter("morning"), "/").select(F.col("user_id").alias("ID"), F.col("v").alias("ich_localisation"))
    pred = per(events.filter("not morning"), "-").select(F.col("user_id").alias("ID"), F.lit("ich ").alias("type"), F.concat("v", F.lit("/U")).alias("structure"))
    return S.location_rows(gt, pred, "ICH", "ich_location")


def set_overlap_per_user(spark, sf):
    x = _location_rows(spark, sf)
    return x.select("ID", F.array_join("gt", "/").alias("gt"), F.array_join("pred", "/").alias("pred"), "correct", *(F.round(f"score.{c}", 9).alias(c) for c in ("coverage", "precision", "jaccard")), F.array_join("missing", "/").alias("missing"))


def set_overlap_summary(spark, sf):
    x = S.flexible_metrics(_location_rows(spark, sf))
    return x.select("total", "no_detection", *(F.round(c, 9).alias(c) for c in x.columns[2:]))


def strict_set_accuracy(spark, sf):
    return S.strict_metrics(_location_rows(spark, sf))


def location_error_rows(spark, sf):
    return S.error_rows(_location_rows(spark, sf))


def severity_accuracy(spark, sf):
    k = F.col("p_partkey")
    part = read(spark, sf, "part")
    gt = part.select(k.alias("ID"), pick(P.SEVERITIES, k).alias("phe_intensity"))
    pred = part.filter(k % 4 != 0).select(k.alias("ID"), F.lit("PHE").alias("type"), pick(P.SEVERITIES, F.col("p_size")).alias("size"))
    rows = S.severity_rows(gt, pred)
    return S.severity_metrics(rows).crossJoin(rows.agg(F.count_if("several").alias("n_several")))


# sizes


def size_parse(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(k.cast("string"), pick(P.SIZE_TAILS, k), F.lit("/"), F.col("p_size").cast("string"), pick(P.SIZE_TAILS, F.col("p_size")))
    sizes = F.transform(Z.parse_sizes(text), lambda s: F.array_join(F.transform(s, lambda v: Z.plain_text(F.round(v, 3))), "x"))
    return read(spark, sf, "part").select("p_partkey", F.array_join(sizes, "/").alias("sizes"))


def number_extract(spark, sf):
    """Numbers of whole texts, as sizes are read."""
    numbers = F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return read(spark, sf, "documents").select("doc_id", F.size(numbers).cast("bigint").alias("n"), F.array_join(numbers, " ").alias("numbers"))


def _size_rows(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ID"), "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" mm")).alias("size"))
    odd = lines.filter("l_linenumber % 2 = 1").groupBy("ID").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "size"))), lambda x: x["size"]), "/").alias("size"))
    even = lines.filter("l_linenumber % 2 = 0").withColumn("type", F.lit("ICH"))
    return S.size_rows(odd, even, order=("l_linenumber", "l_partkey", "l_suppkey"))


def tolerance_greedy_match(spark, sf):
    text = lambda c: F.array_join(F.transform(c, lambda s: s[0].cast("int").cast("string")), "/")
    x = _size_rows(spark, sf)
    return x.select("ID", text("missing").alias("missing"), text("extra").alias("extra"), "correct", F.round("score.coverage", 9).alias("coverage"), F.round("score.precision", 9).alias("precision"))


def size_strict(spark, sf):
    return S.strict_metrics(_size_rows(spark, sf))


def size_flexible(spark, sf):
    x = S.flexible_metrics(_size_rows(spark, sf), jaccard=False)
    return x.select("total", "no_detection", *(F.round(c, 9).alias(c) for c in x.columns[2:]))


def size_error_rows(spark, sf):
    return S.error_rows(_size_rows(spark, sf), flexible=True).drop("scores")


def pair_format(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ID"), F.when(F.col("l_partkey") % 11 == 0, B.NO_MEASURE).otherwise(F.col("l_linenumber").cast("string")).alias("measurement_index"), F.col("l_quantity").alias("measurement"), F.when(F.col("l_linestatus") == "O", " MM").otherwise("cm").alias("unit_measure"), "l_linenumber", "l_partkey", "l_suppkey")
    return B.size_texts(lines, ["l_linenumber", "l_partkey", "l_suppkey"])


def unit_to_cm(spark, sf):
    x = read(spark, sf, "part")
    return x.select("p_partkey", F.round(Z.to_cm(F.col("p_size").cast("double"), pick(P.UNITS, F.col("p_partkey"))), 9).alias("cm"))


# report JSON and ground truth


def _report_json(spark, sf):
    k = F.col("p_partkey")
    flag = lambda c: F.when(c, "true").otherwise("false")
    dictation = F.when(k % 10 == 0, '""').when(k % 10 == 1, "5").otherwise('"seen"')
    extra = F.when(k % 7 == 0, "").otherwise(',"loc_c":true')
    checklist = F.concat(F.lit(',"checklist":{"loc_b":'), flag(F.col("p_size") > 25), F.lit(',"loc_a":'), F.when(k % 5 == 0, '"x"').otherwise(flag(k % 2 == 0)), extra, F.lit("}"))
    value = F.concat(F.lit('{"dictation":'), dictation, F.when(k % 17 == 5, "").otherwise(checklist), F.lit(',"measurements":[{"measurements":{"z":{"value":'), (k % 3).cast("string"), F.lit(',"unit":"mm"},"a":{"value":9}},"control_points":[{"position_ras":[1,"q",'), k.cast("string"), F.lit(']},{"position_ras":[0.5,2,3]}]},7,{"measurements":{"w":{"value":'), F.col("p_size").cast("string"), F.lit(',"unit":5}}}]}'))
    name = F.concat(k.cast("string"), pick(P.FILE_TAILS, k))
    parts = spread(read(spark, sf, "part").select("p_partkey", "p_size"))
    return parts.select(X.id_of_file(name).alias("ID"), F.when(k % 13 == 0, "{oops").otherwise(value).alias("value")).filter(F.try_parse_json("value").isNotNull())


def report_texts(spark, sf):
    return B.build_reports(_report_json(spark, sf))


def common_keys(spark, sf):
    return B.common_keys(_report_json(spark, sf))


def checklist_booleans(spark, sf):
    return B.build_booleans(_report_json(spark, sf))


def report_measurements(spark, sf):
    return B.build_measurements(_report_json(spark, sf))


def _flags(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(
        k.alias("ID"), (F.col("p_size") > 40).alias("loc_frontal"), pick(["yes", "no", " True ", "0"], k).alias("loc_temporal"), (k % 6).alias("ivh_third"), (k % 4 == 0).alias("ivh_lateral"),
        (k % 9 == 0).alias("ivh_none"), (k % 8 == 0).alias("phe_none"), (k % 3 == 0).alias("phe_mild"), (k % 16 == 0).alias("phe_severe"),
    )


def multi_label_from_flags(spark, sf):
    return B.ground_truth_labels(_flags(spark, sf))


def outer_join_ids(spark, sf):
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("ID"), "quality")
    docs = read(spark, sf, "documents").select((F.col("doc_id") + 25).alias("ID"), "n_chars")
    return labels.join(docs, "ID", "full_outer")


def ground_truth_join(spark, sf):
    """Labels and sizes of reports of either table: parts' flags and order lines' quantities."""
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ID"), F.col("l_linenumber").cast("string").alias("measurement_index"), F.col("l_quantity").alias("measurement"), F.lit("cm").alias("unit_measure"), "l_partkey", "l_suppkey")
    return B.ground_truth(_flags(spark, sf), lines, order=["l_partkey", "l_suppkey"])


def resume_anti_join(spark, sf):
    from ..sources.writers import only_new

    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("ID"), "source")
    return only_new(docs, read(spark, sf, "labels").select(F.col("doc_id").alias("ID")))


def json_field(spark, sf):
    props = F.try_parse_json("props")
    return read(spark, sf, "events").select("event_id", F.try_variant_get(props, "$.k", "double").alias("k"), F.schema_of_variant(F.try_variant_get(props, "$.k", "variant")).alias("kind"))


# answers


def parse_answer_lines(spark, sf):
    k = F.col("p_partkey")
    line = lambda kind: F.concat(F.lit("**lesion 1: Type = "), kind, F.lit("; size = "), F.col("p_size").cast("string"), F.lit(" x 2 cm; structure="), F.col("p_name"), F.lit("=b; type extra; severity phe = "), k.cast("string"), F.lit(";**\r\n"))
    answer = F.when(k % 7 == 0, "Lesion report: No lesions mentioned.").otherwise(F.concat(F.lit(" Findings\n"), line(pick(P.ANSWER_TYPES, k)), line(F.lit("PHE")), F.lit("2. - lesion 9: type = SAH; type = U; certainty = high;\nlesion X: type = ICH")))
    parts = spread(read(spark, sf, "part").select("p_partkey", "p_size", "p_name"))
    return A.parse_answers(parts.select(k.alias("ID"), answer.alias("DNN Answer")), 1).drop("DNN Answer")


def prompt_messages(spark, sf):
    plain = {3: A.Prompt(A.PROMPTS[3].fields)}  # a prompt without a text of its own
    asked = read(spark, sf, "documents").select("doc_id", A.messages(F.col("text"), 3, plain).alias("m"))
    return asked.select("doc_id", F.size("m").cast("bigint").alias("n"), F.md5(F.col("m")[1]["content"]).alias("user_md5"))


def prompt_texts(spark, sf):
    """What every prompt says of every document."""
    told = F.array(*(F.struct(F.lit(k).cast("bigint").alias("prompt_id"), F.md5(A.messages(F.col("text"), k)[1]["content"]).alias("user_md5")) for k in sorted(A.PROMPTS)))
    return read(spark, sf, "documents").select("doc_id", F.explode(told).alias("t")).select("doc_id", "t.*")


# paths, values


def path_ids(spark, sf):
    k = F.col("page_id")
    path = F.concat(pick(P.PATH_HEADS, k), F.element_at(F.split("url", "/"), -1), pick(P.PATH_TAILS, F.floor(k / 5)))
    return read(spark, sf, "pages").select("page_id", X.prompt_id_of(path).alias("prompt_id"), X.prompt_id_of(path, trailing=False).alias("prompt_id_strict"), X.model_of(path).alias("model"))


def html_meta_id(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.id_of_file(F.concat(F.element_at(F.split("url", "/"), -1), pick(P.FILE_TAILS, F.col("page_id")))).alias("ID"))


def bool_parses(spark, sf):
    k = F.col("p_partkey")
    text = pick(P.BOOL_TEXTS, k)
    number = F.when(k % 5 == 0, None).otherwise((k % 3).cast("double"))
    return read(spark, sf, "part").select("p_partkey", X.parse_bool(text).alias("scored"), X.parse_bool(number).alias("scored_number"), X.parse_bool_value(text, "string").alias("listed"), X.parse_bool_value(number, "number").alias("listed_number"))


def na_tokens(spark, sf):
    x = read(spark, sf, "part").select("p_partkey", pick(P.NA_TEXTS, F.col("p_partkey")).alias("v"), "p_brand")
    return X.na_normalize(x, "v")


# summaries


def _model_metrics(spark, sf):
    docs = read(spark, sf, "documents")
    # some cells have no value: by their count, of whole tables
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n")).filter("n % 3 > 0").select(F.col("lang").alias("metric"), F.col("source").alias("model"), F.col("n").cast("string").alias("value"))


def model_grid_summary(spark, sf):
    values = _model_metrics(spark, sf)
    return M.grid(values.select("metric", F.lit(0).alias("ord")).distinct(), values).drop("ord")


def pivot_metric(spark, sf):
    events = read(spark, sf, "events")
    values = events.groupBy(F.col("event_type").alias("metric"), F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("model")).agg(F.count("*").cast("string").alias("value"))
    cells = M.grid(values.select("metric", F.lit(0).alias("ord")).distinct(), values)
    return M.wide(cells, "model", ["b0", "b1", "b2", "b3"])


def prompt_metric_pivot(spark, sf):
    """Metric by prompt of one model, in order of text: prompt1, prompt10, prompt2."""
    events = read(spark, sf, "events").withColumn("prompt_id", pick(["1", "2", "10"], F.col("user_id")))
    values = events.groupBy(F.col("event_type").alias("metric"), "prompt_id").agg(F.count("*").alias("n")).filter("n % 4 > 0").select("metric", "prompt_id", F.col("n").cast("string").alias("value"), F.lit("m").alias("model"))
    return M.prompt_summary(values, "m", events.select(F.col("event_type").alias("metric"), F.lit(0).alias("ord")).distinct())


def models_in_all_prompts(spark, sf):
    x = read(spark, sf, "documents").select(F.col("source").alias("model"), (F.floor(F.col("doc_id") / 100) % 5).alias("prompt_id"))
    return M.common_names(x)


def first_file_value(spark, sf):
    """Of a model's files the first by path counts."""
    x = read(spark, sf, "pages").select((F.col("page_id") % 7).cast("string").alias("model"), F.lit("m").alias("metric"), F.col("url").alias("path"), F.concat("url", F.lit("#")).alias("value"))
    return M.grid(x.select("metric", F.lit(0).alias("ord")).distinct(), x).select("model", "value")


def summary_long(spark, sf):
    """The summary's rows out of a presence table."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("ID"), F.col("lang").alias("model"))
    hits = _hits(spark, sf).join(docs, "ID").withColumn("prompt_id", F.lit("3"))
    by = ("model", "prompt_id")
    table = S.presence_metrics(S.presence_rows(_truth(spark, sf), hits, "ivh_presence", "IVH", by), by)
    x = M.long_metrics(table, "ivh_presence")
    return x.select("metric", "model", "prompt_id", F.round(F.col("value").cast("double"), 9).alias("value"))


# all scores at once: orders are the ground truth, their lines what models (return flags) said under prompts (line states)


def _scored(spark, sf):
    from .scoring import Options, score_all

    o, label = read(spark, sf, "orders"), lambda c, n: F.concat(F.lit("s"), (F.col(c) % n).cast("string"))
    gt = o.select(
        F.col("o_orderkey").alias("ID"), (F.col("o_orderstatus") == "P").cast("string").alias("all_booleans_false"), (F.col("o_totalprice") > 250000).cast("string").alias("ivh_presence"),
        (F.col("o_custkey") % 2 == 0).cast("string").alias("phe_presence"), pick(P.SEVERITIES, F.col("o_custkey")).alias("phe_intensity"),
        F.concat_ws("/", label("o_custkey", 3), label("o_orderkey", 5)).alias("ich_location"), label("o_orderkey", 4).alias("ivh_location"),
    )
    lines = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ID"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("prompt_id"), pick(["ICH", "IVH", "phe "], F.col("l_linenumber")).alias("type"),
        F.concat_ws("-", label("l_suppkey", 4), label("l_partkey", 5)).alias("structure"), pick(P.SEVERITIES, F.col("l_partkey")).alias("size"),
    )
    return score_all(gt, lines, Options(True, order=("structure", "size")))


def all_scores(spark, sf):
    """Every metric of every model and prompt, by one shuffle of the predictions."""
    scored = _scored(spark, sf)
    x = C.long_values(scored.sums, [(s.source, s.mode) for s in scored], ("model", "prompt_id"))
    return x.withColumn("value", F.round("value", 9))


def all_errors(spark, sf):
    """The lines of all error reports: how many, and of how many characters, a section."""
    scored = _scored(spark, sf)
    lines = C.error_lines(scored.wide, [(s.source, s.mode) for s in scored], ("model", "prompt_id"))
    return lines.groupBy("model", "prompt_id", "metric", "mode", "section").agg(F.count("*").alias("n"), F.sum(F.length(F.substring_index("line", "\t", 2))).alias("chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        presence_confusion, presence_ignore_filter, presence_error_ids, extra_pred_ids, presence_by_source, group_concat_by_type, type_filter,
        keyword_map, ich_structure_map, ivh_structure_map, phe_severity_map, accent_fold_map, format_all, set_overlap_per_user,
        set_overlap_summary, strict_set_accuracy, location_error_rows, severity_accuracy, size_parse, number_extract, tolerance_greedy_match,
        size_strict, size_flexible, size_error_rows, pair_format, unit_to_cm, report_texts, common_keys, checklist_booleans,
        report_measurements, multi_label_from_flags, outer_join_ids, ground_truth_join, resume_anti_join, json_field, parse_answer_lines, prompt_messages, prompt_texts,
        path_ids, html_meta_id, bool_parses, na_tokens, model_grid_summary, pivot_metric, prompt_metric_pivot, models_in_all_prompts,
        first_file_value, summary_long, all_scores, all_errors,
    )
}
