"""The Merkle manifest against a plain build of the same trees."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from reportloom.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests, arity):
    """The root of the digests and each one's siblings on the way to it."""
    paths, level, under = [[] for _ in digests], list(digests), [[k] for k in range(len(digests))]
    while len(level) > 1:
        runs = [range(a, min(a + arity, len(level))) for a in range(0, len(level), arity)]
        for run in runs:
            for k in run:
                for leaf in under[k]:
                    paths[leaf].append(("".join(level[j] for j in run if j < k), "".join(level[j] for j in run if j > k)))
        level, under = [sha(*(level[k] for k in run)) for run in runs], [[x for k in run for x in under[k]] for run in runs]
    return level[0], paths


def plain_manifest(rows, arity):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        groups.setdefault(source, []).append((doc_id, sha(*map(told, (doc_id, source, lang, n_chars, text)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = plain_tree([leaf for _, leaf in groups[s]], arity)
    root, above = plain_tree([trees[s][0] for s in names], arity) if names else (None, [])
    return sorted(repr((d, leaf, trees[s][0], root, [*path, *up])) for s, up in zip(names, above, strict=True) for (d, leaf), path in zip(groups[s], trees[s][1], strict=True))


def found(df):
    return sorted(repr((r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["proof"]])) for r in df.collect())


def odd_rows(n):
    rng = random.Random(n)
    sources = [None, "", "a", "é", "Z", "hot", "hot", "hot", "hot"]
    rows = [(rng.choice([None, *range(n // 2)]), rng.choice([None, "", "x\ny", "long " * 3000, "é😀"]), rng.choice([None, "en"]), rng.choice(sources), rng.choice([None, 3])) for _ in range(n)]
    return [*rows, *rows[:5], (7, "only", "en", "alone", 1)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("n", "arity", "height"), [(1, 3, 6), (40, 3, 6), (200, 3, 1), (200, 2, 2), (333, 3, 2), (9, 5, 1)])
def test_trees_and_proofs(spark, n, arity, height):
    rows = odd_rows(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(merkle.manifest(docs, arity=arity, height=height)) == plain_manifest(rows, arity)


def test_every_proof_leads_to_the_root_and_shows_tampering(spark):
    rows = [(i, f"text\n{i}" if i % 3 else "plain", "en", f"s{i % 4}", i) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    bad = merkle.leaf_digest(F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.FIELDS)
    out = merkle.manifest(docs, also={"bad": bad}).select("doc_id", "root", merkle.folded(F.col("leaf"), F.col("proof")).alias("same"), merkle.folded(F.col("bad"), F.col("proof")).alias("other"))
    for r in out.collect():
        assert r["same"] == r["root"] and (r["other"] == r["root"]) == (r["doc_id"] % 3 == 0)


def test_events_in_any_order_give_the_same_tree():
    digests = [sha(str(k)) for k in range(50)]
    want, _ = plain_tree(digests, 3)
    for seed in range(5):
        order = list(enumerate(digests))
        random.Random(seed).shuffle(order)
        made = merkle.Combiner(top=9)
        ended = [top for k, d in order if (top := made.arrive("g", 50, merkle.Node(0, k, d, {})))]
        assert [t.digest for t in ended] == [want] and not list(made.frontier())


def test_empty_table_and_clashing_columns(spark, empty):
    assert merkle.manifest(empty).collect() == []
    rows = [(1, "a", "en", "s", 1, "x", 2, "y"), (2, "b", None, "s", 1, "x", 2, "y")]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, g string, size long, digest string")
    assert found(merkle.manifest(docs)) == plain_manifest([r[:5] for r in rows], 3)


def test_a_partition_order_of_its_own_changes_nothing(spark):
    rows = odd_rows(80)
    got = [found(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(n))) for n in (1, 7)]
    assert got[0] == got[1]
