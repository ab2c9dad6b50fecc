import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from vectorloom.errors import InvalidConfig
from vectorloom.operators import keyword
from vectorloom.operators.keyword import B, K1, KeywordIndex, diverse, fused
from vectorloom.plans import catalog

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "st", "ü", "9", "x")]


def texts(n=400, seed=5):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(f"{i:03}", " ".join(rng.choices(WORDS, weights, k=rng.randrange(1, 60)))) for i in range(n)] + [("empty", ""), ("marks", "?! -"), ("null", None), ("upper", "KAÜ, Kara!")]


def plain(docs, query, k):
    find = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    held = {i: Counter(find(t)) for i, t in docs if find(t)}
    mean = sum(sum(c.values()) for c in held.values()) / len(held)
    df = Counter(t for c in held.values() for t in c)
    scores = {}
    for i, c in held.items():
        n = sum(c.values())
        s = sum(math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (K1 + 1) / (c[t] + K1 * (1 - B + B * n / mean)) for t in find(query) if t in c)
        if s > 0:
            scores[i] = s
    return sorted(scores.items(), key=lambda r: (-round(r[1], 9), r[0]))[:k]


def test_search_and_pruning(spark, tmp_path, monkeypatch):
    docs = [*texts(), ("odd", "alpha beta gamma kara")]
    index = KeywordIndex.build(spark.createDataFrame(docs, "id string, content string").repartition(3), str(tmp_path / "index"), block_docs=10, folders=4)
    asked = ["kara", "x9 pex Kaü", "kara kara lost", "nothing", "", None, "nux pe9 peü mira", "the ?"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")
    for k in (1, 5, 1000):
        got = {}
        for r in index.search_batch(queries, k).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
        for q, text in enumerate(asked):
            assert got.get(q, []) == [(i, pytest.approx(s, abs=1e-8)) for i, s in plain(docs, text, k)]
    with monkeypatch.context() as m:
        m.setattr(keyword, "ASKED_ROWS", 4)  # a query or two at a time
        assert {(r["query_id"], r["rank"], r["id"]) for r in index.search_batch(queries, 5).collect()} == {(q, n + 1, i) for q, text in enumerate(asked) for n, (i, _) in enumerate(plain(docs, text, 5))}
    one = spark.createDataFrame([(0, "alpha kara lost beta")], "query_id long, query_text string")
    (part, names, terms), *_ = index._parts(one)
    blocks, floors = index.blocks_in_reach(part, names, terms, 1)
    assert floors[0] > 0 and blocks.count() < index.blocks.count() / 10  # most blocks are never scored
    assert index.opened(blocks).count() == blocks.count()
    with monkeypatch.context() as m:
        m.setattr(keyword, "BROADCAST_BLOCKS", 0)  # a list of blocks too long to broadcast
        assert {(r["query_id"], r["rank"], r["id"]) for r in index.search_batch(queries, 5).collect()} == {(q, n + 1, i) for q, text in enumerate(asked) for n, (i, _) in enumerate(plain(docs, text, 5))}
    assert [r["id"] for r in index.search("kara", 3).orderBy("rank").collect()] == [i for i, _ in plain(docs, "kara", 3)]
    with pytest.raises(InvalidConfig):
        index.search("x", 0)


def watched(make, seen):
    """What ``make`` makes, with the sizes of its batches written down."""

    def made(*args, **named):
        run = make(*args, **named)

        def noted(batches):
            for batch in batches:
                with open(seen, "a") as out:
                    out.write(f"{batch.num_rows}\n")
                yield batch

        return lambda batches: run(noted(batches))

    return made


def test_tasks_have_few_blocks_at_once(spark, tmp_path, monkeypatch):
    """However many blocks a task reads, Python gets them by the few."""
    seen = str(tmp_path / "seen")
    monkeypatch.setattr(keyword, "BLOCKS_A_BATCH", 3, raising=False)
    for name in ("_maxima", "_scores_of_blocks"):
        monkeypatch.setattr(keyword, name, watched(getattr(keyword, name), seen))
    index = KeywordIndex.build(spark.createDataFrame(texts(), "id string, content string").coalesce(1), str(tmp_path / "index"), block_docs=5, folders=2)
    index.search_batch(spark.createDataFrame([(0, "kara"), (1, "lost nux")], "query_id long, query_text string"), 3).collect()
    sizes = [int(n) for n in open(seen)]
    assert sum(sizes) > index.blocks.count() > 10 and max(sizes) <= 3
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_empty_index(spark, tmp_path):
    index = KeywordIndex.build(spark.createDataFrame([], "id string, content string"), str(tmp_path / "index"))
    assert not index.search("kara", 3).collect()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/documents.parquet"), reason="needs the driver's tables")
def test_texts_go_to_the_letter_model_once(spark):
    plan = catalog._letter_lists(spark, "/root/testdata/sf0.001", 20)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # the vectors are there already


def test_fusion(spark):
    one = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "a", 1)], "query_id long, id string, rank int")
    two = spark.createDataFrame([(0, "c", 1), (0, "d", 2), (2, "z", 1)], "query_id long, id string, rank int")
    got = [(r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in fused([one, two], 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, "c", round(1 / 63 + 1 / 61, 9), 1), (0, "a", round(1 / 61, 9), 2), (0, "b", round(1 / 62, 9), 3), (1, "a", round(1 / 61, 9), 1), (2, "z", round(1 / 61, 9), 1)]


@pytest.mark.parametrize("weight", [0.0, 0.3, 1.0])
def test_diverse_choice_against_a_plain_one(spark, weight):
    rng = np.random.default_rng(2)
    rows = [(q, f"{i:02}", float(round(rng.random(), 2)), [float(x) for x in rng.integers(-2, 3, 3)]) for q in range(3) for i in range(25)] + [(3, "only", 1.0, [0.0, 0.0, 0.0]), (3, "none", 2.0, None)]
    got = {}
    for r in diverse(spark.createDataFrame(rows, "query_id long, id string, score double, embedding array<float>"), 6, weight).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    cosine = lambda a, b: 0.0 if not any(a) or not any(b) else sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for q in range(4):
        mine, chosen = sorted((r for r in rows if r[0] == q and r[3]), key=lambda r: (-r[2], r[1])), []
        while len(chosen) < 6 and len(chosen) < len(mine):
            value = lambda r: round(weight * r[2] - (1 - weight) * max((cosine(r[3], c[3]) for c in chosen), default=0.0), 9)
            chosen.append(max((r for r in mine if r not in chosen), key=value))
        assert got[q] == [r[1] for r in chosen]
    with pytest.raises(InvalidConfig):
        diverse(spark.createDataFrame(rows, "query_id long, id string, score double, embedding array<float>"), 3, 2.0)
