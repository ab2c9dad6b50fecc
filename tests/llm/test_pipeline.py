import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm.helpers import frame, prose
from tests.llm.test_dedup import closure, normal, simhash
from tests.llm.test_text_operators import toxic_rows
from vectorloom.llm import mixing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables: toxic documents, exact and near copies, three sources."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = toxic_rows(400)
    rows = [(i, t, f"s{i % 3}") for i, t, _ in rows]
    base = prose(9, 600).split()
    rows += [(1000 + i, rows[3 + i][1].replace(" ", "\n"), "s1") for i in range(20) if (3 + i) % 5]
    rows += [(2000 + i, " ".join([*base[:i], "changed", *base[i + 1 :]]), "s2") for i in range(0, 40, 4)]
    rows += [(3000, "", "s0"), (3001, None, "s0")]
    frame(spark, rows, clash=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_against_brute_force(spark, corpus, tmp_path):
    docs, kept = spark.read.parquet(f"{corpus}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept.append((name, [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]))
        assert k == 4 or docs.columns == columns, name
    assert [k[0] for k in kept] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing", "packing"]

    _, given, left = kept[0]
    scores = toxicity.score_documents(spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet"))
    assert {r["doc_id"] for r in left} == {r["doc_id"] for r in scores.collect() if not r["predicted"]}
    bad = {r["doc_id"] for r in given if re.search("vile|nasty|awful", r["text"] or "")}
    assert len(bad - {r["doc_id"] for r in left}) > 0.95 * len(bad) and len({r["doc_id"] for r in left}) > 0.95 * (len(given) - len(bad))

    _, given, left = kept[1]
    first = {}
    for r in sorted(given, key=lambda r: r["doc_id"]):
        first.setdefault(normal(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in left) == sorted(first.values()) and len(left) < len(given)

    _, given, left = kept[2]
    given.sort(key=lambda r: r["doc_id"])
    roots = set(closure([simhash(r["text"]) for r in given]))
    assert sorted(r["doc_id"] for r in left) == sorted(given[k]["doc_id"] for k in roots) and len(left) < len(given)

    _, given, left = kept[3]
    sizes, taken = Counter(), Counter()
    for r in given:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in left:
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    goal = mixing.targets([sizes[s] for s in sorted(sizes)], [3, 1, 2])
    assert [taken[s] for s in sorted(sizes)] == pytest.approx(goal, abs=0.5)

    _, given, pieces = kept[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    crcs = Counter((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0)
    assert crcs == Counter((r["doc_id"], len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in given)
    whole = {(r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in pieces if r["length"] == r["doc_tokens"]}
    made = {(r["doc_id"], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r in given for i in [[*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]]}
    assert whole <= made and len(whole) > 0.8 * len(made)
    filled = defaultdict(int)
    for r in pieces:
        filled[r["sequence_id"]] += r["length"]
    assert sum(filled.values()) == sum(n for _, n in crcs.elements()) and max(filled.values()) <= 4096


def test_run_is_the_last_stage_of_all(spark, corpus):
    rows = __spark_entry__.queries()["pipeline"](spark, corpus)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
