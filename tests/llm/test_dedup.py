import hashlib
import re

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import collect, frame, odd_rows, prose
from vectorloom.llm import exact_dedup, fingerprints, simhash_dedup
from vectorloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_groups(spark, digest_bytes):
    rows = odd_rows() + [(100 + i, prose(i % 7, 900), "s") for i in range(30)]
    got = collect(exact_dedup.exact_duplicates(frame(spark, rows), digest_bytes=digest_bytes))
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(normal(t), []).append(i)
    expected = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        expected += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(expected, key=key)
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_drop_keeps_columns(spark):
    docs = frame(spark, odd_rows())
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(normal(r["text"]) for r in kept.collect()) == sorted({normal(t) for _, t, _ in odd_rows()})


def test_chunks_follow_content():
    gear, a, b = exact_dedup._gear(), prose(1, 4000).encode(), prose(2, 300).encode()
    cuts = lambda data: {data[x:y] for x, y in exact_dedup.chunk_bounds(len(data), exact_dedup.cut_points(data, gear).tolist())}
    assert len(cuts(a) & cuts(b + a)) > 0.8 * len(cuts(a))  # text put before moves the chunks, it doesn't change them
    for data in (a, b"x" * 100_000, b""):
        bounds = exact_dedup.chunk_bounds(len(data), exact_dedup.cut_points(data, gear).tolist())
        assert b"".join(data[x:y] for x, y in bounds) == data and all(y - x <= exact_dedup.MAX_CHUNK for x, y in bounds)


def simhash(text, n=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = np.array([xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles], np.uint64)
    return sum(1 << k for k in range(64) if 2 * int(((h >> np.uint64(k)) & np.uint64(1)).sum()) > len(h))


def closure(prints, radius=3):
    """Smallest index reachable by links, for each fingerprint."""
    prints, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= radius):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("group_size", [1 << 17, 4])
def test_near_components(spark, group_size):
    long = prose(77, 400).split()
    near = [(200 + i, " ".join([*long[:i], "swap", *long[i + 1 :]]), "s") for i in range(0, 60, 3)]
    rows = [r for r in odd_rows() if r[0] is not None] + near
    got = collect(simhash_dedup.near_duplicates(frame(spark, rows), group_size=group_size))
    prints = [simhash(t) for _, t, _ in rows]
    roots = closure(prints)
    least = {}
    for (i, _, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    expected = sorted((i, f"{p:016x}", least[r]) for (i, _, _), p, r in zip(rows, prints, roots, strict=True))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(least)


def test_null_ids_and_drop(spark):
    docs = frame(spark, odd_rows())
    got = collect(simhash_dedup.near_duplicates(docs))
    assert len(got) == len(odd_rows())
    assert next(r for r in got if r["doc_id"] == 21)["component_id"] == 20  # texts without words have fingerprint zero
    kept = simhash_dedup.drop_near_duplicates(frame(spark, [r for r in odd_rows() if r[0] is not None and r[0] != 25]))
    assert kept.columns == docs.columns and {20} == {r["doc_id"] for r in kept.collect() if not normal(r["text"]).strip()}


def test_drop_keeps_one_of_repeated_rows(spark):
    rows = [(1, prose(1, 40), "s"), (1, prose(1, 40), "s"), (2, prose(2, 40), "s"), (None, prose(3, 40), "s"), (None, prose(3, 40), "s"), (1, prose(4, 40), "s")]
    for drop in (simhash_dedup.drop_near_duplicates, exact_dedup.drop_exact_duplicates):
        kept = [(r["doc_id"], r["text"]) for r in drop(frame(spark, rows)).collect()]
        assert len(kept) == 4 and set(kept) == {(i, t) for i, t, _ in rows}


def test_node_partners_against_all_pairs():
    rng = np.random.default_rng(3)
    nodes, open_ = [], [(5, p) for p in range(32)]
    while open_:  # a tree with leaves of many depths
        d, p = open_.pop()
        if d < 12 and rng.random() < 0.6:
            open_ += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        elif rng.random() < 0.9:
            nodes.append((d, p))
    nodes.sort(key=lambda n: n[1] << (64 - n[0]))
    gray = [p ^ (p >> 1) for _, p in nodes]
    for some in (np.arange(len(nodes)), np.arange(0, len(nodes), 3)):
        asked, partners = simhash_dedup.NodePartners(nodes, 3).of(some)
        found = list(zip(some[asked].tolist(), partners.tolist(), strict=True))
        expected = set()
        for i in some.tolist():
            for j in range(len(nodes)):
                both = min(nodes[i][0], nodes[j][0])
                if bin((gray[i] >> (nodes[i][0] - both)) ^ (gray[j] >> (nodes[j][0] - both))).count("1") <= 3:
                    expected.add((i, j))
        assert len(found) == len(set(found)) and set(found) == expected and len(expected) < len(some) * len(nodes)


@pytest.mark.parametrize("alone", [True, False])
def test_tree_walk_finds_all_pairs(alone):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = lambda c: c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 5)).astype(np.uint64), initial=np.uint64(0))
    codes = np.unique(np.array([flips(c) for c in np.repeat(centres, 20)] + list(rng.integers(0, 1 << 63, 300, dtype=np.uint64)), np.uint64))
    sides = [codes] if alone else [codes[::2], codes[1::2]]
    sides = [c[np.argsort(simhash_dedup.gray_rank(c))] for c in sides]
    found = [p for x, y in simhash_dedup.near_pairs(sides[0], None if alone else sides[1], 3) for p in zip(x.tolist(), y.tolist(), strict=True)]
    near = np.bitwise_count(sides[0][:, None] ^ sides[-1][None, :]) <= 3
    expected = {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if not alone or i < j}
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 100


def test_gray_rank():
    codes = np.arange(256, dtype=np.uint64)
    walk = codes[np.argsort(simhash_dedup.gray_rank(codes))]
    assert (np.bitwise_count(walk[1:] ^ walk[:-1]) == 1).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 8), (11, 11)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 6)} | {7: 7, 8: 7, 9: 7} | {k: 100 for k in range(100, 140)} | {k: 200 for k in range(200, 231)}


def voted(text):
    """A text's fingerprint by its definition."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    pairs = list(zip(words, words[1:])) or [(w, None) for w in words]  # noqa: RUF007
    votes = np.zeros(64, np.int64)
    for a, b in pairs:
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        weight = min(fingerprints.MOST_WEIGHT, len(a) + len(b or ""))
        votes += weight * np.array([1 if h >> k & 1 else -1 for k in range(64)])
    return sum(1 << k for k in range(64) if votes[k] > 0)


def test_votes_against_brute_force(spark):
    texts = ["", "one", "One  two", " Über one\ttwo \n", "a b", "x" * 9 + " y", "  lead", "trail  ", *[prose(k, n) for k, n in enumerate((3, 4, 5, 8, 20, 60, 333))], "AÄÖ " * 30, prose(5, 40) + " ", "ab cd ef gh ij"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in collect(fingerprints.fingerprint_documents(frame(spark, rows)))}
    for i, t in enumerate(texts):
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[(i + 1) % len(texts)][:q]
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (f"{voted(t):016x}", f"{voted(edited):016x}"), (t, edited)


def next_ones(rows):
    """(id, text, next text) in order of id, nulls last, and of the text's hash."""

    def order(r):
        h = xxhash.xxh64_intdigest(r[1].encode(), 42)
        return r[0] is None, r[0] or 0, h - (1 << 64) if h >> 63 else h

    rows = sorted(rows, key=order)
    return {(a[0], a[1], b[1]) for a, b in zip(rows, [*rows[1:], rows[0]], strict=True)}


@pytest.mark.parametrize("kind", ["far", "clusters", "one id", "no id"])
def test_next_rows_of_any_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprints, "_BUCKET_ROWS", 3)
    ids = {
        "far": [-(1 << 63), -(1 << 63) + 5, *range(50), 1 << 62, (1 << 63) - 1],
        "clusters": [*range(20), *range(10**6, 10**6 + 30), *range(10**15, 10**15 + 25)],
        "one id": [7] * 60 + [1, 9],
        "no id": [None] * 60 + [3, 4],
    }[kind]
    rows = [(i, prose(k, 6), "s") for k, i in enumerate(ids)]
    made = fingerprints.with_next(frame(spark, rows))
    assert {(r["id"], r["text"], r["next_text"]) for r in made.filter("not ghost").collect()} == next_ones(rows)
    assert max(r["count"] for r in made.groupBy("bucket").count().collect()) < 25  # no bucket holds most of the rows


def test_fingerprints(spark):
    rows = sorted([r for r in odd_rows() if r[0] is not None and r[0] != 25], key=lambda r: r[0])
    got = {r["doc_id"]: r for r in collect(fingerprints.fingerprint_documents(frame(spark, rows)))}
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in got.values()}
    for k, (i, t, _) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)]
        q = len(t) // 4
        edited = t[: len(t) - q] + (after[1] or "")[:q]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        differ = bin(prints[i] ^ prints[after[0]]).count("1")
        assert r["near_next"] == pytest.approx(max(0, np.cos(np.pi * differ / 64)))
        assert 0 <= r["near_edited"] <= 1
        if i % 20 == 0:
            assert r["n_within"] == sum(bin(prints[i] ^ p).count("1") <= 3 for p in prints.values())
        else:
            assert r["n_within"] is None
    same = collect(fingerprints.fingerprint_documents(frame(spark, [(1, "A b c", None), (2, "a  b\nc", None), (3, "A b c", None)])))
    assert len({r["fingerprint"] for r in same}) == 1


def test_edited_texts_need_no_fingerprints(spark):
    rows = odd_rows() + [(900 + i, prose(i, 50), "s") for i in range(20)]
    found = fingerprints.edited_texts(frame(spark, rows))
    assert "_s31" not in found._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (str(r["doc_id"]), r["n_chars"], r["edited_sha256"])
    assert sorted(map(key, found.collect())) == sorted(map(key, fingerprints.fingerprint_documents(frame(spark, rows)).collect()))


def test_fingerprints_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "_BUCKET_ROWS", 3)
    rows = [(i * i, prose(i, 9), "s") for i in range(40)] + [(None, "last words of all", "s"), (9, prose(3, 9), "s")]
    got = collect(fingerprints.with_next(frame(spark, rows)).filter("not ghost"))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    nexts = {(a[0], a[1], b[1]) for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert {(r["id"], r["text"], r["next_text"]) for r in got} == nexts and len(got) == len(rows)


def test_block_tables_find_all_neighbours(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 62), 1 << 62, 30)
    near = [int(b) ^ int(np.bitwise_or.reduce(1 << rng.integers(0, 62, n))) for b in base for n in range(1, 6)]
    codes = sorted({*map(int, base), *near})
    df = spark.createDataFrame([(c,) for c in codes], "fp long")
    found = [(r["q"], r["fp"]) for r in fingerprints.within_radius(df.withColumnRenamed("fp", "q"), df).collect()]
    expected = {(a, b) for a in codes for b in codes if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert len(found) == len(set(found)) and set(found) == expected


@pytest.mark.parametrize("query", [exact_dedup.exact_duplicates, simhash_dedup.near_duplicates, fingerprints.fingerprint_documents, exact_dedup.drop_exact_duplicates, simhash_dedup.drop_near_duplicates])
def test_empty(spark, query):
    assert query(frame(spark, [])).count() == 0
