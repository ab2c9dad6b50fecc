"""Document fingerprints: SimHash by DataFrame functions alone, and a radius search by permuted block tables.

Terms are pairs of neighbouring words (A-Z in lower case; a lone word pairs with nothing), weighted by how often they
occur and by their length, for long words tell more than articles. Each term's 64-bit hash votes on every bit of the
fingerprint, for or against, with the term's weight. Votes are counted two bits at a time: bits ``k`` and ``k + 32`` of
the hashes are summed in one LONG, 32 sums in all, which Spark adds up per task before it shuffles one row per document.

The search cuts fingerprints into blocks (radius + 2 of them). Fingerprints within the radius agree on at least two
whole blocks, so for each pair of blocks a table keyed by them finds all neighbours; a pair of fingerprints that meets
in several tables is taken in the first only, so neighbours need no later deduplication.

Defined cases: null text counts as empty; a text without words has fingerprint zero; equal texts have equal fingerprints;
the next document is the next row in ascending id (null ids last, repeated ids by text), after the last the first; the
only row of a table is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import SPACE_RUN, WORD_RUN, cut

BITS, RADIUS = 64, 3
MOST_WEIGHT = 16
_BUCKETS, _BUCKET_ROWS = 4_000, 2_000  # beyond so many buckets they grow to ten times so many rows
_EXACT = "decimal(20,0)"  # holds differences of any two ids
_LANES = 0x0000000100000001


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SPACE_RUN), lambda w: w != "")


def term_votes(words: Column) -> Column:
    """Array of (hash, weight), one for each pair of neighbouring words; a lone word votes by itself."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # the last word has no right neighbour: it votes alone only where it is the whole text
    kept = F.when(F.size(words) > 1, F.slice(pairs, 1, F.size(words) - 1)).otherwise(pairs)
    return F.transform(
        kept, lambda p: F.struct(F.xxhash64(p["a"], p["b"]).alias("h"), F.least(F.lit(MOST_WEIGHT), F.length(p["a"]) + F.coalesce(F.length(p["b"]), F.lit(0))).cast("long").alias("w"))
    )


def vote_sums(h: Column, w: Column) -> list[Column]:
    """32 sums: the weights voting for bit k in the low half, those for bit k + 32 in the high half; and the whole weight."""
    sums = [F.sum(F.shiftright(h, k).bitwiseAND(F.lit(_LANES)) * w).alias(f"_s{k}") for k in range(32)]
    return [*sums, F.sum(w).alias("_all")]


def signed_bits() -> Column:
    """The fingerprint: bit k is set where the weights for it outvote those against."""
    low, high = [], []
    for k in range(32):
        packed = F.col(f"_s{k}")
        low.append(F.when(packed.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("_all"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        bit = (1 << (k + 32)) if k < 31 else -(1 << 63)
        high.append(F.when(F.shiftrightunsigned(packed, 32) * 2 > F.col("_all"), F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return reduce(lambda a, b: a.bitwiseOR(b), low + high)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Cosine that the angle between two fingerprints stands for, 0 to 1."""
    differ = F.bit_count(a.bitwiseXOR(b))
    return F.greatest(F.lit(0.0), F.cos(differ * F.lit(3.141592653589793 / BITS)))


def _tail(words: Column, shared: Column) -> Column:
    """Words from the last of the first ``shared`` ones on, so that their pairs are those that the shared words lack."""
    first = F.greatest(shared, F.lit(1))
    return F.slice(words, first, F.greatest(F.size(words) - first + 1, F.lit(0)))


def fingerprint_pairs(rows: DataFrame, keys: list[str], text_col: str, edited_col: str, same_col: str) -> DataFrame:
    """``keys``, ``fp``, ``edited_fp``: fingerprints of each row's two texts, whose first ``same_col`` code points are equal.

    Terms of the equal part are hashed and summed once for both: a row's terms are three lists, of both texts, of the
    first only and of the second only, and each list has its own sums.
    """
    text, edited = F.col(text_col), F.col(edited_col)
    # a word at the end of the equal part may go on, so it is not counted among the shared ones
    same = F.substring(text, F.lit(1), F.col(same_col))
    shared = F.greatest(F.regexp_count(same, F.lit(WORD_RUN)) - 1, F.lit(0))
    rows = rows.select(*keys, shared.alias("_shared"), words_of(text).alias("_words"), words_of(edited).alias("_edited"))
    both = F.when(F.col("_shared") > 1, F.slice("_words", 1, F.col("_shared"))).otherwise(F.array().cast("array<string>"))
    lists = [(0, both), (1, _tail(F.col("_words"), F.col("_shared"))), (2, _tail(F.col("_edited"), F.col("_shared")))]
    rows = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("of"), words.alias("words")) for n, words in lists])).alias("_l"))
    terms = rows.select(*keys, F.col("_l.of").alias("_of"), F.explode_outer(term_votes(F.col("_l.words"))).alias("_t"))
    terms = terms.select(*keys, "_of", F.coalesce("_t.h", F.lit(0)).alias("_h"), F.coalesce("_t.w", F.lit(0)).alias("_w"))
    sums = terms.groupBy(*keys, "_of").agg(*vote_sums(F.col("_h"), F.col("_w")))
    names = [f"_s{k}" for k in range(32)] + ["_all"]

    in_text = [F.sum(F.when(F.col("_of") != 2, F.col(c))).alias(c) for c in names]
    in_edited = [F.sum(F.when(F.col("_of") != 1, F.col(c))).alias(f"_e{c}") for c in names]
    two = sums.groupBy(*keys).agg(*in_text, *in_edited)
    first = two.select(*keys, signed_bits().alias("fp"), *[F.col(f"_e{c}").alias(c) for c in names])
    return first.select(*keys, "fp", signed_bits().alias("edited_fp"))


def _refined(rows: DataFrame, cell: list[str], name: str, bucket_rows: int) -> DataFrame:
    """``rows`` with a finer cell: each cell of more than ``bucket_rows`` rows is cut into equal widths between its own least and
    greatest id, or by the text's hash where all its ids are one. There are as many cells as buckets, so these may be broadcast.
    """
    wide = F.col("id").cast(_EXACT)
    facts = rows.groupBy(*cell).agg(F.min("id").alias("_low"), F.max("id").alias("_high"), F.count("*").alias("_rows"))
    facts = facts.filter(F.col("_rows") > bucket_rows).select(
        *[F.col(c).alias(f"_{c}") for c in cell], F.col("_low").cast(_EXACT).alias("_low"), F.col("_high").cast(_EXACT).alias("_high"), F.ceil(F.col("_rows") / bucket_rows).alias("_parts")
    )
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in cell])
    width = F.floor((F.col("_high") - F.col("_low")) / F.col("_parts")) + 1
    by_id = F.floor((wide - F.col("_low")) / width.cast(_EXACT)).cast("long")
    by_hash = F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * F.col("_parts")).cast("long")
    part = F.when(F.col("_parts").isNull(), F.lit(0)).when(F.col("_low").eqNullSafe(F.col("_high")), by_hash).otherwise(by_id)
    return rows.join(F.broadcast(facts), same, "left").withColumn(name, part.cast("long")).select(*rows.columns, name)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the next row's text: ``bucket``, ``nth``, ``id``, ``text``, ``next_text``, ``ghost``.

    Rows are dealt to buckets in order of id and text hash and sorted there: buckets of equal width in id, twice refined where
    many rows fall into one, by the hash where they repeat an id or have none. The first row of each bucket stands once more at the end of the bucket
    before it, as a ghost that is nobody's row, so no order over the whole table is needed.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).first()
    low, high = span["low"] or 0, span["high"] or 0
    bucket_rows = max(_BUCKET_ROWS, min(10 * _BUCKET_ROWS, span["n"] // _BUCKETS))
    cells = max(1, span["n"] // bucket_rows)
    width = (high - low) // cells + 1
    first_cell = F.floor((F.col("id").cast(_EXACT) - F.lit(str(low)).cast(_EXACT)) / F.lit(str(width)).cast(_EXACT)).cast("long")
    rows = rows.withColumn("_c0", F.coalesce(first_cell, F.lit(cells)))  # null ids: a last cell
    rows = _refined(rows, ["_c0"], "_c1", 2 * bucket_rows)
    rows = _refined(rows, ["_c0", "_c1"], "_c2", 2 * bucket_rows)
    rows = rows.select(F.struct("_c0", "_c1", "_c2").alias("bucket"), F.xxhash64("text").alias("hash"), "id", "text")

    # one row for each bucket: in order, each with the bucket before it
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("id", "hash")).alias("first"))
    around = Window.partitionBy(F.lit(0)).orderBy("bucket")
    firsts = firsts.select("bucket", "first", F.lag("bucket").over(around).alias("before"), F.max("bucket").over(Window.partitionBy(F.lit(0))).alias("end"))
    firsts = firsts.select(F.col("bucket").alias("_bucket"), F.col("first").alias("_first"), F.coalesce("before", "end").alias("_before"))
    is_first = (F.col("bucket") == F.col("_bucket")) & F.col("id").eqNullSafe(F.col("_first.id")) & (F.col("hash") == F.col("_first.hash"))
    dealt = rows.join(F.broadcast(firsts), is_first, "left").withColumn("ghost", F.explode(F.when(F.col("_before").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    dealt = dealt.withColumn("home", F.when(F.col("ghost"), F.col("_before")).otherwise(F.col("bucket")))
    last = Window.partitionBy("home").orderBy(F.col("ghost"), F.col("id").asc_nulls_last(), F.col("hash"), F.col("text"))
    return dealt.select(
        F.col("home").alias("bucket"), F.row_number().over(last).cast("long").alias("nth"), "id", "text", F.lead("text").over(last).alias("next_text"), "ghost"
    )


def _edits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of :func:`with_next` with ``n_chars``, ``edited``, the edited text (of ghosts: empty), and ``same``, how many code
    points it begins with that are the text's.
    """
    rows = with_next(docs, id_col, text_col)
    same = F.expr("length(text) - cast(length(text) div 4 as int)")
    quarter = F.expr("cast(length(text) div 4 as int)")
    edited = F.when(F.col("ghost"), F.lit("")).otherwise(F.concat(F.substring(F.col("text"), F.lit(1), same), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter)))
    return rows.select("bucket", "nth", "id", "ghost", F.length("text").cast("long").alias("n_chars"), "text", F.when(F.col("ghost"), F.lit(0)).otherwise(same).alias("same"), edited.alias("edited"))


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_chars`` and ``edited_sha256``, without fingerprints."""
    rows = _edits(docs, id_col, text_col).filter(~F.col("ghost"))
    return rows.select(F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, nth, id, n_chars, edited_sha256, fp, edited_fp, next_fp): each text, and its edited text, fingerprinted.

    The edited text has the last quarter of the code points replaced by as many from the start of the next document.
    """
    rows = _edits(docs, id_col, text_col)
    keys = ["bucket", "nth", "id", "ghost", "n_chars", "edited_sha256"]
    # as bytes, half as long, while it is shuffled
    one = fingerprint_pairs(rows.withColumn("edited_sha256", F.unhex(F.sha2("edited", 256))), keys, "text", "edited", "same")
    along = Window.partitionBy("bucket").orderBy("nth")
    one = one.withColumn("next_fp", F.lead("fp").over(along)).filter(~F.col("ghost")).drop("ghost")
    return one.withColumn("edited_sha256", F.lower(F.hex("edited_sha256")))


def block_bounds(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(shift, bits) of radius + 2 blocks that cover the 64 bits."""
    blocks, at, out = radius + 2, 0, []
    for k in range(blocks):
        bits = BITS // blocks + (k < BITS % blocks)
        out.append((at, bits))
        at += bits
    return out


def block_tables(prints: DataFrame, fp_col: str, radius: int = RADIUS) -> DataFrame:
    """Each fingerprint once for every pair of blocks: ``table_no``, ``block_key`` (the two blocks side by side)."""
    blocks = block_bounds(radius)

    def key(i: int, j: int) -> Column:
        part = [F.shiftrightunsigned(F.col(fp_col), s).bitwiseAND(F.lit((1 << b) - 1)) for s, b in (blocks[i], blocks[j])]
        return F.shiftleft(part[0], blocks[j][1]).bitwiseOR(part[1])

    pairs = list(combinations(range(len(blocks)), 2))
    tables = F.array(*[F.struct(F.lit(t).alias("table_no"), key(i, j).cast("long").alias("block_key")) for t, (i, j) in enumerate(pairs)])
    return prints.withColumn("_table", F.explode(tables)).select("*", "_table.table_no", "_table.block_key").drop("_table")


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q, fp): for each distinct query fingerprint ``q``, all fingerprints ``fp`` at most ``radius`` bits away, once each."""
    blocks = block_bounds(radius)
    pairs = list(combinations(range(len(blocks)), 2))
    differ = F.col("q").bitwiseXOR(F.col("fp"))

    def same(k: int) -> Column:
        shift, bits = blocks[k]
        return F.shiftrightunsigned(differ, shift).bitwiseAND(F.lit((1 << bits) - 1)) == 0

    # the first table, in their order, on whose two blocks the pair agrees
    meets = F.coalesce(*[F.when(same(i) & same(j), F.lit(t)) for t, (i, j) in enumerate(pairs)])
    left, right = block_tables(queries, "q", radius), block_tables(prints.withColumnRenamed("table_no", "_") if "table_no" in prints.columns else prints, "fp", radius)
    right = right.select(F.col("fp"), F.col("table_no").alias("_no"), F.col("block_key").alias("_key"))
    match = (F.col("table_no") == F.col("_no")) & (F.col("block_key") == F.col("_key")) & (F.bit_count(differ) <= radius) & (meets == F.col("table_no"))
    return left.join(right, match).select("q", "fp")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, every: int = 20) -> DataFrame:
    """One row per input row: the id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``, and for the rows whose id ``every`` divides (the search's queries)
    ``n_within``: how many rows' fingerprints lie within the radius of theirs, themselves included; null for other rows.
    """
    made = cut(fingerprint_edits(docs, id_col, text_col))
    prints = made.groupBy("fp").agg(F.count("*").alias("rows"))
    asked = made.filter(F.pmod("id", F.lit(every)) == 0).select(F.col("fp").alias("q")).distinct()
    found = within_radius(asked, prints.select("fp"), radius)
    counts = found.join(prints, "fp").groupBy("q").agg(F.sum("rows").alias("n_within"))
    is_query = F.pmod("id", F.lit(every)) == 0
    joined = made.join(counts, (made["fp"] == counts["q"]) & is_query, "left")
    return joined.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        hex_of(F.col("fp")).alias("fingerprint"),
        hex_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(is_query, F.col("n_within")).alias("n_within"),
    )
