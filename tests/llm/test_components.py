"""Connected components: as union-find, in rounds of few tasks."""

import random

from reportloom.llm import simhash


def plain(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


def test_components_are_those_of_union_find(spark):
    rng = random.Random(5)
    graphs = [
        [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(280)],
        [(50, i) for i in range(100)] + [(i, 50) for i in range(60)],  # a hub between, edges twice and a loop
        [(7, 7)],
    ]
    for pairs in graphs:
        assert {x.node: x.root for x in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == plain(pairs)


def test_a_round_is_two_stages_of_shuffled_tasks(spark, monkeypatch):
    """With many partitions tasks are what small graphs cost: a round had six and more stages of them."""
    n, rounds = 16, []
    monkeypatch.setattr(simhash, "written", lambda df, name, old=simhash.written: rounds.append(name) or old(df, name))
    conf = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    sc = spark.sparkContext
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("rounds", "rounds")
        out = simhash.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("rounds") for s in tracker.getJobInfo(j).stageIds}
    wide = sum(i.numTasks == n and i.numCompletedTasks == n for i in map(tracker.getStageInfo, stages))
    assert wide <= len(rounds) - 1, (wide, len(rounds))  # a round writes two tables: least ones and edges
    assert {x.root for x in out.collect()} == {0}
