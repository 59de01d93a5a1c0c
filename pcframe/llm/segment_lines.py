"""Line dedup: equal lines and lines within a few edits of an earlier one, by a segment-partition
edit join, with built-in functions only."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pcframe.llm.common import cut

#: Edits within which two lines count as the same, and the least length for anything but equality.
EDITS, LEAST_CHARS = 1, 20
#: Lines whose ids (16 bytes each) or keys are broadcast at most; more are joined by a shuffle.
BROADCAST_LINES = 500_000
#: Lines that share a segment are compared pair by pair up to so many; more are split further.
HOT = 16
_BLANK = " \t\n\r\x0b\x0c"


def _segment(line: Column, n: Column, l_: Column, i: int, edits: int, shift: Column | int = 0) -> Column:
    """Hash of (length l_, segment i, the substring of line where that segment of a line of length
    l_ would stand, moved by shift). Segments are even; the last ones are the longer."""
    parts = edits + 1
    q, longer = F.floor(l_ / parts).cast("int"), l_ % parts
    length = q + F.when(F.lit(i) > parts - longer, 1).otherwise(0)
    start = 1 + (i - 1) * q + F.greatest(F.lit(0), F.lit(i - 1 - parts) + longer) + shift
    ok = (start >= 1) & (start + length - 1 <= n)
    return F.when(ok, F.xxhash64(l_.cast("int"), F.lit(i), F.substr(line, start.cast("int"), length.cast("int"))))


def index_keys(line: Column, edits: int) -> list[Column]:
    """A key for each of a line's edits + 1 segments."""
    n = F.length(line)
    return [_segment(line, n, n, i, edits) for i in range(1, edits + 2)]


def probe_keys(line: Column, edits: int) -> list[tuple[int, Column]]:
    """(characters less, key): keys under which every line shorter by so many and within the
    edits has a segment: for each segment, the starts that its left and right neighbours allow."""
    n, out = F.length(line), []
    for less in range(edits + 1):
        for i in range(1, edits + 2):
            low, high = max(-(i - 1), less - (edits + 1 - i)), min(i - 1, less + edits + 1 - i)
            out += [(less, _segment(line, n, n - less, i, edits, s)) for s in range(low, high + 1)]
    return out


def _common(a: Column, b: Column, most: Column, at: Callable[[Column, Column, Column], Column]) -> Column:
    """Length of the longest common prefix (as at() takes substrings), by doubling steps downwards."""
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), lambda s: s <= most)
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= most) & (at(a, p, s) == at(b, p, s)), p + s).otherwise(p))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts are within the edits (insertions, deletions, substitutions of a code
    point), by a banded bit-parallel automaton.

    Bit d of row e says that the first j + d - edits code points of a and the first j of b are
    within e edits; rows of 2 * edits + 1 bits, the band, stand side by side in one long (so at
    most 4 edits). A code point of b moves all bits at once: matches keep a bit, an edit moves it
    to the next row, on the same diagonal or a neighbouring one. What both texts begin and end
    with is taken away first.
    """
    if not 0 <= edits <= 4:
        raise ValueError("edits must lie in 0..4")
    w = 2 * edits + 1
    row = lambda e: ((1 << w) - 1) << (e * w)
    every = sum(row(e) for e in range(edits + 1))
    low = sum(1 << (e * w) for e in range(edits + 1))  # diagonal 0 of each row
    start = sum(sum(1 << (edits + i) for i in range(e + 1)) << (e * w) for e in range(edits + 1))

    def core(x: Column, p: Column, s: Column) -> Column:
        return F.substr(x, p + 1, F.length(x) - p - s)

    def skipped(from_: int) -> Callable[[Column], Column]:
        return lambda m: m.bitwiseOR(F.shiftleft(m.bitwiseAND(F.lit(from_).cast("long")), w + 1))

    def run(pair: Column) -> Column:
        left, right = pair["a"], pair["b"]

        def step(state: Column, j: Column) -> Column:
            here = F.get(right, j)
            same = [F.when(F.coalesce(F.get(left, j + (d - edits)) == here, F.lit(False)), F.lit(sum(1 << (e * w + d) for e in range(edits + 1)))).otherwise(F.lit(0)) for d in range(w)]
            match = same[0]
            for x in same[1:]:
                match = match.bitwiseOR(x)
            moved = state.bitwiseAND(match.cast("long"))
            if edits:
                changed = F.shiftleft(state, w)
                dropped = F.shiftleft(F.shiftright(state.bitwiseAND(F.lit(every & ~low).cast("long")), 1), w)
                moved = moved.bitwiseOR(changed).bitwiseOR(dropped).bitwiseAND(F.lit(every).cast("long"))
            for e in range(1, edits + 1):  # code points of a alone, row after row
                moved = F.transform(F.array(moved), skipped(row(e - 1) & ~(1 << (e * w - 1))))[0]
            return moved

        n, m = F.size(left), F.size(right)
        end = F.when(m == 0, F.lit(start).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), F.lit(start).cast("long"), step))
        bit = F.expr(f"{edits * w + edits}") + n - m
        return (F.abs(n - m) <= edits) & (F.call_function("getbit", end, F.greatest(F.least(bit, F.lit(63)), F.lit(0))) == 1)

    chars = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))
    shorter = F.least(F.length(a), F.length(b))
    prefix = _common(a, b, shorter, lambda x, p, s: F.substr(x, p + 1, s))
    # each name that is used more than once is bound by a transform over one element
    cut_ = F.transform(F.array(prefix), lambda p: F.struct(p.alias("p"), _common(a, b, shorter - p, lambda x, q, s: F.substr(x, F.length(x) - q - s + 1, s)).alias("s")))
    cores = F.transform(cut_, lambda c: F.struct(chars(core(a, c["p"], c["s"])).alias("a"), chars(core(b, c["p"], c["s"])).alias("b")))
    return (F.abs(F.length(a) - F.length(b)) <= edits) & F.transform(cores, run)[0]


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast, if it (a table) has no more rows than that."""
    return F.broadcast(df) if df.count() <= BROADCAST_LINES else df


def _window_key(line: Column, length: Column, a: Column, b: Column) -> Column:
    """Of a line within one edit of one of so many code points: hash of all but what the shorter
    one has at [a, b), where the edit is. What is left of it keeps its place, what is right of it
    its distance to the end."""
    n = F.length(line)
    return F.xxhash64(length, a, b, F.substr(line, F.lit(1), a), F.substr(line, n - (length - b) + 1, length - b))


def _met(entries: DataFrame) -> DataFrame:
    """entries (key, k1, longer, ...; a table) of keys under which a line and another one, of its
    own length or longer, meet; and how many do."""
    met = entries.groupBy("key").agg(F.count("*").alias("lines"), F.count(F.when(~F.col("longer"), 1)).alias("own")).where("own > 0 and lines > 1")
    return cut(entries.join(_small(cut(met.select("key", "lines"), "line-keys")), "key"), "line-entries")


def _paired(entries: DataFrame) -> DataFrame:
    """Pairs of the lines under a key, which are HOT at most."""
    few = entries.where(F.col("lines") <= HOT)
    one = few.where("not longer").select("key", F.col("k1").alias("a"))
    two = few.select("key", F.col("k1").alias("b"), "longer")
    return one.join(two, "key").where("longer or a < b").select("a", "b")


def _one_edit_pairs(distinct: DataFrame, lines: DataFrame) -> list[DataFrame]:
    """Candidate pairs (a, b) for one edit: two segments a line, and, where many lines share one,
    halves of the other segment, and so on, down to one code point. All lines of equal length that
    share everything but one code point are within an edit: each is paired with the first. A
    longer line is paired with the only one that has all its code points but one."""
    halves = [F.struct(F.col(f"{kind}{j}").alias("key"), F.lit(kind == "pr").alias("longer"), F.lit(j).alias("half")) for kind in ("ix", "pr") for j in range(2)]
    entries = distinct.select("k1", "ord", F.explode(F.array(*halves)).alias("e")).select("k1", "ord", "e.*").where("key is not null")
    entries, pairs = _met(entries), []
    pairs.append(_paired(entries))
    hot = cut(entries.where(F.col("lines") > HOT).select("k1", "ord", "longer", "half").distinct(), "hot-lines")
    if hot.isEmpty():
        return pairs
    texts = lines.select("k1", "line").join(_small(cut(hot.select("k1").distinct(), "hot-ids")), "k1").groupBy("k1").agg(F.min("line").alias("line"))
    length, middle = F.col("length"), F.floor(F.col("length") / 2).cast("int")
    hot = hot.join(texts, "k1").withColumn("length", F.length("line") - F.col("longer").cast("int"))
    hot = cut(hot.select("k1", "ord", "longer", "line", "length", F.when(F.col("half") == 0, middle).otherwise(0).alias("lo"), F.when(F.col("half") == 0, length).otherwise(middle).alias("hi")), "hot-texts")
    while not hot.isEmpty():
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.array(F.struct(F.col("lo").alias("x"), mid.alias("y")), F.struct(mid.alias("x"), F.col("hi").alias("y")))
        split = hot.select("k1", "ord", "longer", "line", "length", F.explode(parts).alias("p")).select("k1", "ord", "longer", "line", "length", F.col("p.x").alias("lo"), F.col("p.y").alias("hi"))
        split = _met(cut(split.where("lo < hi").withColumn("key", _window_key(F.col("line"), length, F.col("lo"), F.col("hi"))), "line-windows"))
        pairs.append(_paired(split))
        many = split.where(F.col("lines") > HOT)
        last = many.where("hi - lo = 1")
        first = last.where("not longer").groupBy("key").agg(F.min(F.struct("ord", "k1"))["k1"].alias("a"))
        pairs.append(last.where("not longer").join(first, "key").select("a", F.col("k1").alias("b")).where("a <> b"))
        letter = lambda i: F.substr("line", F.col("lo") + i, F.lit(1))
        own = last.where("not longer").select("key", letter(1).alias("letter"), F.col("k1").alias("a"))
        more = last.where("longer").select("key", F.explode(F.array_distinct(F.array(letter(1), letter(2)))).alias("letter"), F.col("k1").alias("b"))
        pairs.append(own.join(more, ["key", "letter"]).select("a", "b"))
        hot = cut(many.where("hi - lo > 1").drop("key", "lines"), "hot-texts")
    return pairs


def _many_edit_pairs(distinct: DataFrame, edits: int, probes: list[tuple[int, Column]]) -> list[DataFrame]:
    """Candidate pairs (a, b): lines that share a segment where the edits allow it."""
    indexed = distinct.select(F.col("k1").alias("a"), F.explode(F.array_compact(F.array(*[f"ix{j}" for j in range(edits + 1)]))).alias("key"))
    tagged = [F.struct(F.col(f"pr{j}").alias("key"), F.lit(less > 0).alias("shorter")) for j, (less, _) in enumerate(probes)]
    probing = distinct.select(F.col("k1").alias("b"), F.explode(F.array(*tagged)).alias("p")).select("b", "p.key", "p.shorter").where("key is not null")
    return [indexed.join(probing, (indexed["key"] == probing["key"]) & (F.col("shorter") | (F.col("a") < F.col("b")))).select("a", "b")]


def near_lines(lines: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Of lines (k1, k2: hashes of the line; line; ord: where it stands), one row per distinct
    line: k1, k2, ord (of its first place), copies, near (an earlier line is within the edits)."""
    line, n = F.col("line"), F.length("line")
    long_ = n >= least_chars
    if edits == 1:  # segments of equal and of one more code point are a prefix and a suffix
        q = lambda l_: F.floor(l_ / 2).cast("int")
        halves = lambda l_: [_window_key(line, l_, q(l_), l_), _window_key(line, l_, F.lit(0), q(l_))]
        own, probes = halves(n), [(1, k) for k in halves(n - 1)]
    else:
        own, probes = index_keys(line, edits), probe_keys(line, edits)
    keys = [F.when(long_, c).alias(f"ix{j}") for j, c in enumerate(own)] + [F.when(long_, c).alias(f"pr{j}") for j, (_, c) in enumerate(probes)]
    names = [f"ix{j}" for j in range(len(own))] + [f"pr{j}" for j in range(len(probes))]
    # equal lines have equal keys: min() carries them through a hash aggregate, texts stay behind
    distinct = cut(lines.select("k1", "k2", "ord", *keys).groupBy("k1", "k2").agg(F.min("ord").alias("ord"), F.count("*").alias("copies"), *[F.min(c).alias(c) for c in names]), "lines")

    # k1 alone names a line here: lines that share it are all looked at again below
    found = _one_edit_pairs(distinct, lines) if edits == 1 else _many_edit_pairs(distinct, edits, probes)
    pairs = functools.reduce(DataFrame.unionByName, found)
    pairs = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    wanted = _small(cut(pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct(), "line-ids"))
    texts = cut(lines.select("k1", "k2", "ord", "line").join(wanted, "k1").groupBy("k1", "k2").agg(F.min("ord").alias("ord"), F.min("line").alias("line")), "candidate-lines")
    of = lambda x: texts.select(F.col("k1").alias(x), F.col("k2").alias(f"{x}2"), F.col("ord").alias(f"{x}_ord"), F.col("line").alias(f"{x}_line"))
    checked = pairs.join(of("a"), "a").join(of("b"), "b").where(within(F.col("a_line"), F.col("b_line"), edits))
    first_a = F.col("a_ord") > F.col("b_ord")
    later = checked.select(F.when(first_a, F.col("a")).otherwise(F.col("b")).alias("k1"), F.when(first_a, F.col("a2")).otherwise(F.col("b2")).alias("k2")).distinct().withColumn("near", F.lit(True))
    return distinct.select("k1", "k2", "ord", "copies").join(later, ["k1", "k2"], "left").select("k1", "k2", "ord", "copies", F.coalesce("near", F.lit(False)).alias("near"))


def dedup(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text; with keep_columns the columns of docs, the text
    being what is kept.

    Lines are split at \\n and compared without white space at their ends; lines without a word
    are neither compared nor removed. In order of document id and line number, a line goes if an
    equal line stands before it, or if a line within the edits (insertions, deletions,
    substitutions of a code point) does, that line itself kept or not. Lines shorter than
    least_chars go only if equal.

    A line within the edits of another, cut into one segment more than edits, has a segment that
    stands unchanged in the other, so equal segments find all pairs; within() confirms them on
    the whole lines. With one edit, a segment that more than HOT lines share is refined by halves
    of the other, so pairs grow with the lines and not with the square of a template's; with more
    edits, the lines of a segment are joined, a join that Spark splits.

    Null text: no lines, kept as it is. Rows of null id are left as they are. Repeated rows of an
    id with the same text count as one document. An empty table gives no rows.
    """
    key = F.xxhash64(F.col(f"`{text_col}`"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), key.alias("__key"))
    slim = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), key.alias("__key")).where(F.col("__id").isNotNull() & F.col("__text").isNotNull())
    lines = slim.select("__id", "__key", F.posexplode(F.split("__text", "\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", F.btrim("raw", F.lit(_BLANK))).where("line <> ''")
    place = (F.col("__id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("pos")).cast("decimal(38,0)")
    lines = lines.select("__id", "__key", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), place.alias("ord"), "line")
    found = cut(near_lines(lines, edits, least_chars).where("near or copies > 1").select("k1", "k2", F.col("ord").alias("first"), "near"), "distinct-lines")
    gone = lines.drop("line").join(_small(found), ["k1", "k2"]).where("near or ord > first")
    gone = gone.groupBy("__id", "__key").agg(F.collect_set("pos").alias("__gone")).select(F.col("__id").alias("__i"), F.col("__key").alias("__k"), "__gone")
    out = own.join(gone, (F.col("__id") == F.col("__i")) & (F.col("__key") == F.col("__k")), "left")
    at = F.coalesce("__gone", F.array().cast("array<int>"))
    split = F.split("__text", "\n")
    marked = F.map_from_arrays(at, F.transform(at, lambda p: F.lit(True)))
    kept = F.when(F.size(at) == 0, F.col("__text")).otherwise(F.expr("array_join(filter(split(__text, '\n'), (x, i) -> not map_contains_key(__map, i)), '\n')"))
    out = out.withColumn("__map", marked).withColumn("__kept", kept)
    if keep_columns:
        return out.select(*[(F.col("__kept") if c == text_col else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
    return out.select(F.col("__id").alias("doc_id"), F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.size(at).cast("long").alias("n_removed"), F.col("__kept").alias("kept_text"))
