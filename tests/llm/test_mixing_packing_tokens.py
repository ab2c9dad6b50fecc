import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import collect, frame, odd_rows, prose
from vectorloom.llm import mixing, packing, token_files
from vectorloom.llm.tokenize import WordEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200, 250 / 3, 500 / 3]
    assert sum(mixing.targets([10, 1000, 5], [3, 1, 2])) == pytest.approx(1522.5)
    assert mixing.targets([0, 0], [3, 1]) == [0, 0] and mixing.targets([], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutation(n):
    p = mixing.permute(np.arange(n), n, 7)
    assert sorted(p) == list(range(n)) and (mixing.permute(p, n, 7, inverse=True) == np.arange(n)).all()


def test_shards_share_out_all_slots():
    counts = np.array([1000, 3, 0, 777])
    parts = [mixing.split_counts(counts, s, 18, 100) for s in range(18)]
    assert (sum(p[1] for p in parts) == counts).all()
    assert all((parts[s + 1][0] == parts[s][0] + parts[s][1]).all() for s in range(17))
    assert [p[1].sum() for p in parts] == [100] * 17 + [80]


def test_draw_is_uniform():
    """Against the hypergeometric distribution's mean and spread, small and far beyond what numpy's own draw takes."""
    rng = np.random.default_rng(8)
    for counts, n in ((np.array([700, 40, 0, 260]), 300), (np.array([700, 40, 0, 260]), 900), (np.array([5 * 10**11, 3 * 10**9, 17, 10**12]), 4 * 10**11)):
        draws = np.array([mixing.draw_without_replacement(counts, n, rng) for _ in range(2000)])
        assert (draws.sum(1) == n).all() and (draws >= 0).all() and (draws <= counts).all()
        total = counts.sum()
        share = counts / total
        spread = np.sqrt(n * share * (1 - share) * ((total - n) / (total - 1)))
        wide = spread > 0
        assert (np.abs(draws.mean(0) - n * share)[wide] < 5 * spread[wide] / np.sqrt(2000)).all()
        assert draws.std(0)[wide] == pytest.approx(spread[wide], rel=0.15)


def test_slots_meet_the_target_exactly():
    for size in (1, 63, 64, 65, 1000, 6401):
        for target in (0, 1, size // 2, size, size * 3 // 2, size * 2):
            p = mixing.plan_source("s", 3, size, float(target))
            words = 0
            for j in range(p.slots):
                t, at = divmod(j, p.blocks)
                block = mixing.block_words(int(mixing.permute(np.array([at]), p.blocks, mixing._key(3, t))[0]), size, 64)
                words += min(block, p.last_words) if j == p.slots - 1 else block
            assert words == target, (size, target)


def test_mix(spark):
    rows = odd_rows()
    got = collect(mixing.mix_shares(frame(spark, rows)))
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]]) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in order)
    assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got) == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in collect(mixing.mix_shares(frame(spark, rows))))


def test_mixed_texts_hold_what_is_taken(spark):
    docs = frame(spark, odd_rows())
    made = mixing.mix_texts(docs)
    words = sum(len(WORD.findall(r["text"])) for r in made.collect())
    assert made.columns == docs.columns and words == sum(r["taken"] for r in collect(mixing.mix_shares(docs)))
    originals = {i: WORD.findall(t or "") for i, t, _ in odd_rows() if i is not None}
    for r in made.collect():
        if r["doc_id"] in originals:
            assert not Counter(WORD.findall(r["text"])) - Counter(originals[r["doc_id"]])


def spans_of(spark, docs, block):
    """The mix told again by formula: which blocks of its source each row's words fill, and which slots take these."""
    documents, _ = mixing.mix(docs, block=block)
    rows = [r.asDict() for r in documents.collect()]
    by = defaultdict(list)
    for r in rows:
        by[r["source_no"]].append(r)
    taken = Counter()
    for no, held in by.items():
        held.sort(key=lambda r: (r["at"], r["size"]))
        owner = [(r["row"], k) for r in held for k in range(r["size"])]
        assert [r["at"] for r in held if r["size"]] == [sum(x["size"] for x in held[:k]) for k, r in enumerate(held) if r["size"]]
        plan = mixing.plan_source(None, no, len(owner), held[0]["target"], block)
        for j in range(plan.slots):
            turn, place = divmod(j, plan.blocks)
            b = int(mixing.permute(np.array([place]), plan.blocks, mixing._key(no, turn))[0])
            words = owner[b * block : (b + 1) * block][: plan.last_words if j == plan.slots - 1 else None]
            taken.update(row for row, _ in words)
    return {r["row"]: taken[r["row"]] for r in rows}, rows


def test_taken_words_against_brute_force(spark):
    docs = frame(spark, odd_rows() + [(300, prose(1, 90), "src0")] * 3)
    expected, rows = spans_of(spark, docs, 8)
    got = mixing.mix_shares(docs, block=8).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got) == sorted((r["id"] or -1, r["size"], expected[r["row"]]) for r in rows)


def test_repeated_rows_meet_their_own_takes(spark):
    text = prose(1, 200)
    rows = [(7, text, "a")] * 5 + [(7, prose(2, 200), "a"), (None, text, "a"), (8, prose(3, 30), "b")]
    docs = frame(spark, rows, clash=False)
    for block in (7, 64):
        made = Counter()
        for r in mixing.mix_texts(docs, block=block).collect():
            made[r["doc_id"]] += len(r["text"].split())
        told = Counter()
        for r in mixing.mix_shares(docs, block=block).collect():
            told[r["doc_id"]] += r["taken"]
        assert made == +told


def test_take_spans(spark):
    df = spark.createDataFrame([(" a  b\nc d e ", [(0, 2), (3, 1)]), ("x", [])], "text string, spans array<struct<start:long,words:long>>")
    assert [r[0] for r in df.select(mixing.take_spans(F.col("text"), F.col("spans"))).collect()] == ["a b d", ""]


def test_multinomial_counts_differ_between_shards(spark):
    _, pieces = mixing.mix(frame(spark, [(i, prose(i, 500), f"s{i % 2}") for i in range(40)], clash=False), block=8, shard_slots=100)
    slots = pieces.select("shard", "slot").distinct()
    assert slots.count() == pieces.groupBy("shard", "slot").count().count()
    assert {r["count"] for r in slots.groupBy("shard").count().collect()} >= {100}


TEXTS = [t or "" for _, t, _ in odd_rows()] + ["don't STOP <|endoftext|> 42 naïve ﬁ Σίσυφος\x1cx\u0085y z 'S ### a<|b", "x" * 5000, "é́ é ´ 漢字 123 İ"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_encoder_equals_tokenizer(tokenizer):
    encoder = WordEncoder(cache_words=50)
    for _ in range(2):
        for t in TEXTS:
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("window", "merge_tasks"), [(4096, 64), (64, 2)])
def test_packing(spark, tokenizer, monkeypatch, window, merge_tasks):
    monkeypatch.setattr(packing, "MERGE_TASKS", merge_tasks)
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(1000 + i, prose(i, i % 90), None) for i in range(200)] + [(5000, None, None)]
    got = collect(packing.pack(frame(spark, rows).repartition(5), window=window, open_windows=3))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    padding = total = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= window
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else window - at)
    assert padding <= 0.02 * total
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces.pop(i), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert not pieces


def test_repeated_and_null_ids_are_packed(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "c", None)]
    assert sorted((r["doc_id"] or 0, r["length"]) for r in packing.pack(frame(spark, rows)).collect()) == [(0, 2), (1, 3), (1, 3)]


@pytest.mark.parametrize("block", [1 << 21, 2, 6, 64])
def test_token_counts(spark, tokenizer, block):
    rows = [(i, t, None) for i, t in enumerate(TEXTS[:12] + TEXTS[-6:])] + [(99, None, None)]
    if block > 64:
        rows = [(i, t, None) for i, t in enumerate(TEXTS)]
    else:
        rows = [(i, " ".join((t or "").split()[:20]), s) for i, t, s in rows]
    got = {r["doc_id"]: r for r in collect(token_files.count_document_tokens(frame(spark, rows), block_bytes=block))}
    for i, t, _ in rows:
        assert got.pop(i)["tokens"] == len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert not got


def test_rows_behind_a_shuffle_are_settled_first(spark, tmp_path):
    frame(spark, [(i, prose(i, i % 9), None) for i in range(60)], clash=False).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert token_files._settled(table.select("doc_id", "text")) is not None
    plain, shuffled = table.filter("doc_id < 50"), table.repartition(5).filter("doc_id < 50")
    assert token_files._settled(plain) is plain and token_files._settled(shuffled) is not shuffled
    one, two = ({r["doc_id"]: r["tokens"] for r in token_files.count_document_tokens(d).collect()} for d in (plain, shuffled))
    assert one == two and len(one) == 50


def test_flat_files(spark, tmp_path):
    end = token_files.END_OF_DOCUMENT
    files = {"a": [1, 2, end, end, 5], "b": [end], "c": [], "d": [7, 7, 7], "e": [*range(300), end] * 3}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    got = collect(token_files.count_tokens(spark, str(tmp_path), block_bytes=8))
    found = sorted((r["file"][-1], r["doc_no"], r["start"], r["tokens"], r["ended"]) for r in got)
    assert found == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 1, False), ("b", 0, 0, 0, True), ("d", 0, 0, 3, False), *[("e", k, 301 * k, 300, True) for k in range(3)]]


@pytest.mark.parametrize("query", [mixing.mix_shares, mixing.mix_texts, packing.pack, token_files.count_document_tokens])
def test_empty(spark, query):
    assert query(frame(spark, [])).count() == 0
