"""Documents for the operators' tests: nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["row", "id", "size", "fp", "body", "keep_id", "score", "_score", "group_size", "recipe", "sequence_id", "bucket", "edited", "spans", "kept", "a", "b", "_loom", "_loom_sha", "_sha", "_n"]
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "ki") for b in ("ran", "sel", "tim", "von", "wus", "xy")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows, clash=True):
    """(doc_id, text, source) rows as documents, with clashing extra columns."""
    df = spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], DOCS).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}) if clash else df


def odd_rows():
    base = [(i, prose(i, 5 + 7 * i), f"src{i % 3}") for i in range(20)]
    return base + [
        (20, None, "src0"), (21, "", "src1"), (22, "", None), (23, " \n\t ", "src2"), (None, prose(3, 26), None), (None, None, None),
        (24, prose(24, 40_000), "src0"), (25, base[4][1], "src1"), (25, base[4][1], "src1"), (26, base[4][1].replace(" ", "\n\n"), "src2"),
        (27, "one", "é"), (28, "ONE", "z"), (29, "Ünïcode 𝒳 words 漢字", "src1"), (30, base[19][1] + " end", "src1"), (31, base[19][1] + " fin", "src1"),
    ]


def collect(df):
    return [r.asDict() for r in df.collect()]
