"""The pipeline on a small folder of tables: each stage against brute force."""

import pytest

import corpus_pipeline as P
from reportloom.llm import queries


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    rows = docs.filter("doc_id = 10").selectExpr("1L AS item_id", "text")
    rows.write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, texts, clashing):
    from .test_operators import plain_components, plain_fingerprint

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = P.keep_known_languages(spark, docs, folder)
    assert known.columns == docs.columns
    letters = {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in known.collect()} <= letters
    kept = sorted(r["doc_id"] for r in P.drop_near_duplicates(spark, docs, folder).collect())
    assert kept == sorted(set(plain_components([plain_fingerprint(t) for t in texts]).values()))
    clean = P.drop_contaminated(spark, docs, folder)
    gone = set(range(len(texts))) - {r["doc_id"] for r in clean.collect()}
    assert 10 in gone and clean.columns == docs.columns and len(gone) < 6
    assert P.redact_secrets(spark, docs, folder).count() == len(texts)
    assert P.encode_pieces(spark, docs, folder).columns == ["doc_id", "ids", "n_tokens"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, clashing, folder).columns == clashing.columns
    assert P.drop_near_duplicates(spark, clashing, folder).count() == 2
    empty = docs.filter("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_names_and_ids_of_rows(spark, folder, texts):
    """Columns named as the stages' own ones, and an id that many rows have."""
    some = [t for t in texts[3:17] if len(t) > 150][:4]
    rows = [(7, t, "en", "s", 5, "x", "y", "z") for t in [*some, some[0]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _pipeline_row string, _PIPELINE_lang string, _pipeline_rejected string")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        got = out.collect()
        assert out.columns == docs.columns, name
        if name != "decontamination":  # the folder's item may be one of them
            assert (len(got) == {"simhash": 4}.get(name, 5) or name == "language_id"), name  # too few texts to know a language
        assert {(r["_pipeline_row"], r["_PIPELINE_lang"], r["_pipeline_rejected"]) for r in got} <= {("x", "y", "z")}
    assert P.encode_pieces(spark, docs, folder).count() == 5


def test_run(spark, folder):
    assert 0 < P.run(spark, folder).count() < 35
    assert [name for name, _ in P.STAGES] == ["language_id", "simhash", "decontamination", "secret_scan", "sentencepiece"]


def test_queries_cover_all_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
