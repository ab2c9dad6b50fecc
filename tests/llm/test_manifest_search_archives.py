"""Merkle manifest, ranked search and web archives, each against a plain version of its contract."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.helpers import collect, frame, odd_rows, prose
from vectorloom.llm import merkle, ranked_search, warc


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, low=False):
    out = []
    for c in merkle.COLUMNS:
        v = r[c] if r[c] is None else str(r[c])
        if v is not None and low and c == "text":
            v = re.sub("[A-Z]", lambda m: m[0].lower(), v)
        out.append("-" if v is None else f"{len(v.encode())}:{v}")
    return digest(*out)


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    trees = {x: levels_of([plain_leaf(r) for r in groups[x]]) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs])
    for at, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            way, leaf = [], plain_leaf(r)
            for levels, k in ((trees[lang], i), (top, at)):
                for nodes in levels[:-1]:
                    way.append((nodes[k // 8 * 8 : k], nodes[k + 1 : k // 8 * 8 + 8]))
                    k //= 8
            folded = plain_leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0)
            for left, right in way:
                folded = digest(*left, folded, *right)
            root = top[-1][0]
            yield r["doc_id"], leaf, trees[lang][-1][0], root, digest(*(x for left, right in way for x in left + right)), folded, folded == root


def as_rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("n, langs", [(0, 1), (1, 1), (8, 1), (9, 2), (65, 3), (520, 2), (600, 75)])
def test_manifest(spark, n, langs):
    rng = random.Random(n)
    names = [None, *(f"é{k}" if k % 5 == 0 else f"x{k}" for k in range(langs - 1))]
    rows = [(i if i % 11 else None, None if i % 7 == 3 else f"Ab{i % 4} É", rng.choice(names), f"s{i % 3}", i) for i in range(n)]
    rows += rows[: n // 10]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).withColumns({c: F.lit("clash") for c in ("leaf", "id", "g", "i", "n", "node", "run", "claimed", "path", "at", "root")})
    got = merkle.verify_documents(df)
    told = list(plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]))
    assert as_rows(got, MANIFEST) == sorted(told, key=str)
    if n > 100:
        assert {True, False} == {r["verified"] for r in got.select("verified").distinct().collect()}


def test_manifest_of_one_hot_group_stays_spread(spark):
    """A third of the rows alike, id and all, are numbered by several tasks."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"), F.lit("same").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = merkle.numbered(rows.withColumn("tie", F.monotonically_increasing_id()), [F.col("id").asc_nulls_first(), F.col("tie")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["at"] for r in placed.select("at").collect()) == list(range(3000))
    assert placed.filter("id is null").select(F.spark_partition_id()).distinct().count() > 1


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, queries, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in queries:
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(heapq.nsmallest(k, scored, key=lambda r: r[:3]))]
    return sorted(out, key=str)


def test_terms_are_those_of_the_contract():
    every = "".join(map(chr, range(0x250))) + "ÀÉ漢字 𝒳 \x85a b"
    assert [t.decode() for t in ranked_search.terms_of(every.encode())] == terms(every)


def test_search_over_odd_rows(spark):
    docs = odd_rows()
    asked = [(0, prose(5, 12)), (1, None), (2, ""), (3, "漢字 words"), (4, "nothing like it"), (5, "one ONE one"), (6, docs[4][1]), (None, prose(8, 4)), (7, prose(9, 30) + " ünïcode")]
    queries = spark.createDataFrame([(i, t, "x") for i, t in asked], "item_id long, text string, score string")
    told = plain_search([(i, t) for i, t, _ in docs], asked, 20)
    got = ranked_search.search(frame(spark, docs), queries)
    assert as_rows(got, ("item_id", "rank", "doc_id", "score")) == told
    blocks = ranked_search.search(frame(spark, docs), queries, block_terms=5)
    assert as_rows(blocks, ("item_id", "rank", "doc_id", "score")) == told
    assert not ranked_search.search(frame(spark, []), queries).collect()
    assert not ranked_search.search(frame(spark, docs), queries.limit(0)).collect()


def test_search_with_many_equal_scores(spark):
    """Ties beyond k in several shards and tasks: the smallest ids stay, null first."""
    docs = [(i if i else None, "even words" if i % 2 else "odd words and more") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    queries = [(0, "even"), (1, "odd more"), (2, "words")]
    got = ranked_search.search(df, spark.createDataFrame(queries, "item_id long, text string"), k=7)
    assert as_rows(got, ("item_id", "rank", "doc_id", "score")) == plain_search(docs, queries, 7)


@pytest.mark.parametrize("seed", range(4))
def test_branch_and_bound_finds_what_all_scores_say_and_opens_less(seed):
    rng = np.random.default_rng(seed)
    n_docs, n_terms = 3000, 40
    dense = np.where(rng.random((n_terms, n_docs)) < rng.random((n_terms, 1)) ** 3, rng.integers(1, 9, (n_terms, n_docs)), 0)
    places, counts = np.concatenate([np.flatnonzero(row) for row in dense]), (dense > 0).sum(1)
    tree = ranked_search.Tree(counts.astype(np.int64), places.astype(np.int64), np.concatenate([row[row > 0] for row in dense]).astype(np.int64), n_docs)
    asked, weights = np.arange(0, n_terms, 3), rng.integers(1, 50, len(range(0, n_terms, 3)))
    best, ids = ranked_search.Best(10), [int(x) for x in rng.permutation(n_docs)]
    opened = ranked_search.search_shard(tree, ids, asked, weights, best)
    scores = weights @ dense[asked]
    assert best.rows == sorted(((int(s), ids[d]) for d, s in enumerate(scores)), key=lambda r: (-r[0], r[1]))[:10]
    assert opened <= -(-n_docs // 16) + -(-n_docs // 256) + 2
    # one document stands out: the search goes straight to it
    dense[asked, 1234] = 9
    places, counts = np.concatenate([np.flatnonzero(row) for row in dense]), (dense > 0).sum(1)
    tree = ranked_search.Tree(counts.astype(np.int64), places.astype(np.int64), np.concatenate([row[row > 0] for row in dense]).astype(np.int64), n_docs)
    best = ranked_search.Best(1)
    assert ranked_search.search_shard(tree, ids, asked, weights, best) < 60 and best.rows[0][1] == ids[1234]


def test_shards_are_bounded_and_hold_every_posting(spark, tmp_path):
    docs = odd_rows()
    shards = ranked_search.build_index(frame(spark, docs), str(tmp_path / "index"), shard_docs=4, shard_postings=60)
    rows = collect(shards)
    assert all(len(r["ids"]) <= 4 for r in rows) and len({r["shard"] for r in rows}) == len(rows)
    told = Counter((t, n) for _, text, _ in docs for t, n in Counter(terms(text)).items())
    got = Counter()
    for r in rows:
        freqs = np.frombuffer(r["freqs"], np.int32)
        for t, n in zip(np.repeat(np.array([bytes(x).decode() for x in r["terms"]], object), r["counts"]), freqs, strict=True):
            got[t, int(n)] += 1
    assert got == told


PAGE = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def plain_records(rows):
    best, first, out = {}, set(), []
    number = lambda p: -1 if p is None else p
    for p, _, h in rows:
        best[h or ""] = max(best.get(h or "", -2), number(p))
    for p, _, h in rows:
        h, data = h or "", (h or "").encode()
        response = len(data) < 1000 or (number(p) == best[h] and h not in first)
        if response and len(data) >= 1000:
            first.add(h)
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit", None if response or best[h] < 0 else best[h]))
    return sorted(out, key=str)


def page_rows():
    rows = [(i if i % 9 else None, f"http://a.example/\r\n{i % 4}?q=é" if i % 5 else None, None if i % 7 == 0 else "é" * (495 + i % 8) + "x" * (i % 2)) for i in range(120)]
    return rows + rows[:40] + [(500, "u", "long " * 300_000), (501, "v", "long " * 300_000), (502, "w", "")]


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).withColumns({c: F.lit("clash") for c in ("payload", "digest", "key", "size", "part", "record_id", "best", "times", "k")})


def test_archive_round_trip(spark):
    rows = page_rows()
    got = warc.archive_pages(pages_frame(spark, rows))
    assert as_rows(got, PAGE) == plain_records(rows)
    assert not warc.archive_pages(pages_frame(spark, []).limit(0)).collect()


def test_bundles_are_plain_zstandard_and_seekable(spark, tmp_path):
    rows, path = page_rows(), str(tmp_path / "archive")
    index = collect(warc.write_archives(pages_frame(spark, rows), path, frame_bytes=5000, bundle_bytes=1500))
    assert len(index) == len(rows) == len({r["record_id"] for r in index})
    bundles = sorted({r["bundle"] for r in index})
    whole = {}
    for b in bundles:  # from end to end, by a reader that knows nothing of the table
        with open(f"{path}/{b}", "rb") as f:
            whole[b] = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    parsed = [r for b in bundles for r in warc.parse_records(whole[b])]
    assert len(parsed) == len(rows)
    assert all(r["warc-profile"] == warc.REVISIT_PROFILE and r["payload"] == b"" for r in parsed if r["warc-type"] == "revisit")
    records = collect(warc.read_archives(spark, path))
    texts = Counter((p, (h or "").encode()) for p, _, h in rows)
    by_id = {r["record_id"]: r for r in records}
    full = lambda r: bytes((r if r["record_type"] == "response" else by_id[r["refers_id"]])["payload"])
    assert Counter((None if r["page_id"] is None else int(r["page_id"]), full(r)) for r in records) == texts
    some = index[::7]
    ids = spark.createDataFrame([(r["record_id"],) for r in some] * 2 + [("urn:uuid:none",)], "record_id string")
    found = {r["record_id"]: r for r in collect(warc.look_up(spark, path, ids))}
    assert found == {r["record_id"]: by_id[r["record_id"]] for r in some}


def test_leftovers_of_a_lost_attempt_are_not_read_and_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "archive")
    index = collect(warc.write_archives(pages_frame(spark, page_rows()[:20]), path))
    (tmp_path / "archive" / "left-behind.warc.zst").write_bytes(b"half a bundle")
    assert warc.read_archives(spark, path).count() == 20
    name = tmp_path / "archive" / index[0]["bundle"]
    data = bytearray(name.read_bytes())
    data[-10] ^= 1  # in the seek table's last checksum
    name.write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        warc.read_archives(spark, path).collect()
