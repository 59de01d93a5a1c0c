"""Document fingerprints: threshold-scaled sketches of word shingles, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pcframe.llm.common import native_words

SHINGLE = 5
#: One shingle in so many is retained; of a text with at most WHOLE distinct shingles, all are.
SCALE, WHOLE = 8, 64
#: First in the sketch of a whole set; hashes have 63 bits and no sign.
_ALL = -1
#: Rows that one bucket of the id order holds about, the most buckets there are, and the
#: quantiles of the ids between which buckets are of equal width.
BUCKET_ROWS, MAX_BUCKETS, QUANTILES = 2_048, 65_536, 1_024


def _limit(scale: int) -> Column:
    return F.lit((1 << 63) // scale)


def _is_whole(s: Column) -> Column:
    return (F.size(s) == 0) | (F.get(s, F.lit(0)) == _ALL)


def _below(s: Column, scale: int) -> Column:
    """What the fixed fraction retains."""
    return F.filter(s, lambda x: (x >= 0) & (x < _limit(scale)))


def _sketch_of(hashes: Column, scale: int) -> Column:
    """The sketch of distinct hashes of a whole set."""
    whole = F.concat(F.array(F.lit(_ALL).cast("long")), F.array_sort(hashes))
    return F.when(F.size(hashes) == 0, hashes).when(F.size(hashes) <= WHOLE, whole).otherwise(F.array_sort(_below(hashes, scale)))


def sketch(text: Column, k: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct 63-bit hashes of the text's k-word shingles that lie below 1/scale of
    their range; of at most WHOLE distinct shingles all, behind a -1, as the fraction says little
    of so few. A text of fewer than k words has one shingle, all its words.

    Sketches merge: see merge(). The text must be a column; null is empty, with sketch [].
    """
    word = lambda w: F.xxhash64(w)
    hashes = F.transform(native_words(text), word)

    def of(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - k)
        whole = F.array(F.aggregate(h, F.lit(k).cast("long"), lambda a, x: F.xxhash64(a, x)))
        rolled = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < k, whole).otherwise(rolled)

    # transform over a one-element array binds a name to what is used more than once
    bound = F.transform(F.array(hashes), of)[0]
    positive = F.array_distinct(F.transform(bound, lambda x: x.bitwiseAND(F.lit((1 << 63) - 1))))
    return F.transform(F.array(positive), lambda h: _sketch_of(h, scale))[0]


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of what two sketches stand for."""
    union = F.array_union(F.filter(a, lambda x: x >= 0), F.filter(b, lambda x: x >= 0))
    return F.when(_is_whole(a) & _is_whole(b), _sketch_of(union, scale)).otherwise(F.array_sort(_below(union, scale)))


def _compared(a: Column, b: Column, scale: int) -> Column:
    """Both sketches' hashes at the scale that both have: all, or the fixed fraction."""
    all_ = lambda s: F.filter(s, lambda x: x >= 0)
    both = F.when(_is_whole(a) & _is_whole(b), F.struct(all_(a).alias("a"), all_(b).alias("b")))
    return both.otherwise(F.struct(_below(a, scale).alias("a"), _below(b, scale).alias("b")))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Resemblance: common share of the two sets' union, exact if both are whole, else estimated
    at the fixed fraction; two empty ones are alike."""
    union = lambda p: F.size(F.array_union(p["a"], p["b"]))
    share = lambda p: F.when(union(p) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(p["a"], p["b"])) / F.greatest(union(p), F.lit(1)))
    return F.transform(F.array(_compared(a, b, scale)), share)[0]


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Share of a's shingles that b has, however unequal the two are. An empty a is contained.
    Null if the fixed fraction has none of a's and b is not whole: b's sketch then can't tell."""
    share = lambda p: F.when(F.size(p["a"]) > 0, F.size(F.array_intersect(p["a"], p["b"])) / F.greatest(F.size(p["a"]), F.lit(1)))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.transform(F.array(_compared(a, b, scale)), share)[0])


def as_string(s: Column) -> Column:
    """Hashes in hexadecimal, a whole set's behind '*'."""
    return F.array_join(F.transform(s, lambda x: F.when(x == _ALL, F.lit("*")).otherwise(F.hex(x))), ".")


def _bucket(order: Column, tie: Column, cuts: list[int], per: int, nulls: int) -> Column:
    """Number of a row's bucket, rising in descending order: quantile ranges, found by binary
    search, and equal parts of each; null orders last, by parts of the tie hash's range."""
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << i) for i in range(len(cuts).bit_length() - 1, -1, -1)])
    # how many cuts are at most the order; the least one always is
    place = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(cuts)) & (F.get(bounds, F.least(p + s, F.lit(len(cuts))) - 1) <= order), p + s).otherwise(p))

    def part(p: Column) -> Column:
        lo, hi = F.get(bounds, p - 1).cast("double"), F.coalesce(F.get(bounds, p), F.lit(cuts[-1])).cast("double")
        inside = F.floor((order.cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * per).cast("long")
        return (F.lit(len(cuts)).cast("long") - p) * per + (per - 1) - F.least(F.greatest(inside, F.lit(0)), F.lit(per - 1))

    of_null = F.lit(len(cuts) * per).cast("long") + F.least(F.floor((tie.cast("double") / 2.0**64 + 0.5) * nulls).cast("long"), F.lit(nulls - 1))
    return F.when(order.isNull(), of_null).otherwise(F.transform(F.array(place), part)[0])


def with_next(rows: DataFrame, order: str, carried: list[str], tie: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """rows with next_<c> for each carried column: of the row that follows in descending order
    of an integral column, after the last the first. prepare may add columns to carry; it runs
    once for each row, before the rows are dealt out.

    The order is cut into buckets between quantiles; each row goes to one bucket, and the first
    of each bucket also to the bucket before it, so no task sees more than a bucket and the rows
    are shuffled once. Null orders come last; ties follow the hash of the tie column, then itself.
    """
    q = [i / QUANTILES for i in range(QUANTILES)]
    span = rows.agg(F.count("*").alias("n"), F.count(order).alias("known"), F.percentile_approx(F.col(order).cast("long"), q, 10 * QUANTILES).alias("cuts")).first()
    cuts = sorted(set(span["cuts"] or [0]))  # the first is the least order
    buckets = max(1, min(MAX_BUCKETS, span["known"] // BUCKET_ROWS))
    nulls = max(1, min(MAX_BUCKETS, (span["n"] - span["known"]) // BUCKET_ROWS))
    rows = rows.withColumn("__h", F.xxhash64(tie))
    rows = rows.withColumn("__b", _bucket(F.col(order).cast("long"), F.col("__h"), cuts, max(1, -(-buckets // len(cuts))), nulls))
    by = [F.col(order).desc_nulls_last(), F.col("__h"), F.col(tie)]
    # the first row of each bucket, and the bucket before it that has rows (round the end)
    first_of = F.min(F.struct(F.bitwise_not(F.col(order).cast("long")).alias("o"), F.col("__h").alias("h")))  # not(x) falls as x rises
    heads = rows.groupBy("__b").agg(first_of.alias("__head"))
    around = Window.orderBy("__b")  # at most 2 * MAX_BUCKETS and a few rows
    heads = heads.withColumn("__to", F.coalesce(F.lag("__b").over(around), F.max("__b").over(Window.partitionBy()))).select("__b", "__head", "__to")
    first = rows.join(F.broadcast(heads), "__b").where((F.col("__h") == F.col("__head.h")) & F.bitwise_not(F.col(order).cast("long")).eqNullSafe(F.col("__head.o")))
    first = first.withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy(*by))).where("__n = 1")
    copies = first.select(*[F.col("__to").alias("__b") if c == "__b" else F.col(c) for c in rows.columns], F.lit(1).alias("__copy"))
    w = Window.partitionBy("__b").orderBy("__copy", *by)
    both = prepare(rows.withColumn("__copy", F.lit(0)).unionByName(copies))
    for c in carried:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where("__copy = 0").drop("__b", "__h", "__copy")


def fingerprints(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each whole text and of its edited text, and how alike they are.

    Edited: the last floor(n/2) code points replaced by the first as many of the next document
    in descending id order. Null text: empty (fingerprint ''; two empty texts are alike, 1.0).
    Repeated rows and ties of the id follow one another in order of the text's hash; null ids
    come last. A table of one row has itself as its next; an empty table gives no rows. Other
    columns are left out.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    t = with_next(t, "doc_id", ["__text", "__sketch"], "__text", lambda df: df.withColumn("__sketch", sketch(F.col("__text"), k, scale)))
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    t = t.withColumn("n_chars", n.cast("long")).withColumn("__edited", F.concat(F.expr("substring(__text, 1, length(__text) - cast(floor(length(__text) / 2) as int))"), F.substring(F.col("next___text"), F.lit(1), half)))
    t = t.select("doc_id", "n_chars", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), "__sketch", "next___sketch", sketch(F.col("__edited"), k, scale).alias("__edited_sketch"))
    a, e, x = F.col("__sketch"), F.col("__edited_sketch"), F.col("next___sketch")
    return t.select(
        "doc_id", "n_chars", "edited_sha256", as_string(a).alias("fingerprint"), as_string(e).alias("edited_fingerprint"),
        likeness(a, e, scale).alias("near_edited"), likeness(a, x, scale).alias("near_next"), containment(a, e, scale).alias("contained_in_edited"), containment(a, x, scale).alias("contained_in_next"),
    )
