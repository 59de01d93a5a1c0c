"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcframe.llm import words as W
from pcframe.llm.common import MASK64, cut, discard, mix64, release, small_batches, window_hashes
from pcframe.llm.components import components

#: Signature components (a prime) and how bands cut them: two texts of resemblance 0.8 share
#: no band with probability (1 - 0.8**5)**25, 5e-5; of 0.85, 3e-7.
SLOTS, BANDS, ROWS = 127, 25, 5
#: Bytes of text that are shingled, and elements and sets whose signatures are made, at once.
TEXT_BYTES, ELEMENTS, SETS = 2_000_000, 250_000, 4_096
#: Shingles of the members of a candidate group that one task verifies at once.
CHUNK_SHINGLES = 100_000
#: Ids of candidate documents (8 bytes each) that are broadcast at most, to leave the texts of
#: all others where they are; more ids meet the texts by a shuffle.
BROADCAST_IDS = 1_000_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, shape (n, slots), of n sets; elements[i] is of set owner[i].

    Each element deals itself to the slots in an order of its own, a permutation (affine, modulo
    the prime number of slots): at step j its value is j plus a uniform fraction, so its ranks
    are correlated over the slots and every slot gets a different one. A slot keeps the least
    value. A set stops once all its slots are below j + 1, as later steps can't lower any.
    Sets without elements keep infinity.
    """
    out = np.full((n, slots), np.inf)
    x, at = elements, owner
    shift = mix64(x ^ np.uint64(0x5DEECE66D))
    start, stride = (shift % np.uint64(slots)).astype(np.int64), ((shift >> np.uint64(32)) % np.uint64(slots - 1)).astype(np.int64) + 1
    flat = out.reshape(-1)
    for j in range(slots):
        value = j + (mix64(x + np.uint64((j + 1) * int(_GOLDEN) & MASK64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        np.minimum.at(flat, at * slots + (start + stride * j) % slots, value)
        live = out.max(1) >= j + 1
        keep = live[at]
        if not keep.any():
            break
        if not keep.all():
            x, at, start, stride = x[keep], at[keep], start[keep], stride[keep]
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """64-bit hashes of BANDS runs of ROWS slots each, shape (n, BANDS)."""
    bits = np.ascontiguousarray(sig).view(np.uint64)
    out = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), (b + 1) * int(_GOLDEN) & MASK64, np.uint64)
        for r in range(ROWS):
            h = mix64(h ^ bits[:, b * ROWS + r]) + _GOLDEN
        out[:, b] = h
    return out


def shingle_sets(texts: pa.StringArray, k: int) -> list[np.ndarray]:
    """Of each text: the sorted distinct 64-bit hashes of its k-word shingles; a shorter text's
    words are one, told apart by their number. A-Z is lower-cased."""
    words = W.split(texts, lower=True)
    lanes = W.hashes(words.distinct)
    h, counts = W.windows(words, lanes, k, 0)
    ends, sizes = np.cumsum(counts), np.diff(words.ends, prepend=0)
    out = []
    for i, (size, end, n) in enumerate(zip(sizes.tolist(), ends.tolist(), counts.tolist())):
        out.append(np.unique(h[end - n : end]) if n or not size else window_hashes(lanes[words.of(i)], size, 0) + np.uint64(size))
    return out


def _signatures(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """A few sets at a time, so that neither long nor many short texts take much memory."""
    ends, first, parts = np.cumsum(sizes), 0, [np.empty((0, SLOTS))]
    while first < len(sets):
        done = int(ends[first - 1]) if first else 0
        last = min(first + SETS, max(first + 1, int(np.searchsorted(ends, done + ELEMENTS, "right"))))
        parts.append(signatures(np.concatenate(sets[first:last]), np.repeat(np.arange(last - first), sizes[first:last]), last - first))
        first = last
    return np.concatenate(parts)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in W.lots(batch.column(1), TEXT_BYTES):
                sets = shingle_sets(texts, k)
                sizes = np.array([len(s) for s in sets], np.int64)
                bands = band_hashes(_signatures(sets, sizes)).view(np.int64)
                digest = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(sizes), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], ["doc_id", "n_shingles", "d1", "d2", "bands"])
        release()

    return run


def _digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in W.lots(batch.column(1), TEXT_BYTES):
                sets = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array([_digest(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "d1", "blob"])
        release()

    return run


def spanning_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links (of set numbers) that span the components of all pairs with den*|intersection| >=
    num*|union|. An index of each set's rarest shingles finds the pairs: two alike sets share one
    among the first n - ceil(n*num/den) + 1 of each, in order of how many sets have a shingle.
    Found pairs are compared whole, unless links have connected them already."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, every = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.empty(0, np.uint64)
    _, code, count = np.unique(every, return_inverse=True, return_counts=True)
    order = np.lexsort((code, count[code], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes + num * sizes // -den + 1  # n - ceil(n * num / den) + 1
    kept = order[place < prefix[owner]]  # owners rise along order
    code, owner = code[kept], owner[kept]
    by = np.lexsort((owner, code))
    starts = np.searchsorted(code[by], code, "left")
    lengths = np.searchsorted(code[by], code, "right") - starts
    posted, mine = owner[by], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
    links, roots = [], np.arange(len(sets))  # roots: union-find labels, all paths of length one

    for i, s in enumerate(sets):
        a, b = mine[i], mine[i + 1]
        near = np.unique(W.gather(posted, starts[a:b], lengths[a:b]))
        near = near[(near > i) & (roots[near] != roots[i]) & (den * np.minimum(sizes[near], sizes[i]) >= num * np.maximum(sizes[near], sizes[i]))]
        if not len(near):
            continue
        others = np.concatenate([sets[j] for j in near])
        at = np.searchsorted(s, others)
        at[at == len(s)] = 0
        inter = np.add.reduceat((s[at] == others).astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
        for j in near[den * inter >= num * (sizes[i] + sizes[near] - inter)].tolist():
            if roots[i] != roots[j]:
                links.append((i, j))
                low, high = sorted((roots[i], roots[j]))
                roots[roots == high] = low
    return links


def _verify(num: int, den: int):
    """Links of one chunk of a candidate group, on whole sets."""

    def run(chunk: pa.Table) -> pa.Table:
        ids = chunk.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        blobs = chunk.column("blob").to_pylist()
        links = spanning_links([np.frombuffer(blobs[i], np.uint64) for i in order], num, den)
        a, b = ([int(ids[order[x[side]]]) for x in links] for side in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _counted(df: DataFrame) -> DataFrame:
    """Marked for broadcast, if it (a table, or a small part of one) has no more rows than BROADCAST_IDS."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts are split at ASCII white space with A-Z lower-cased; a set is the distinct k-word
    shingles (a shorter text's words are one; no words: an empty set, linked with nothing).
    Two documents are linked if 100*|intersection| >= 80*|union|, confirmed on the full sets.

    1. One pass makes set digests and SuperMinHash bands. 2. Documents of equal sets become one
    class, whose least id stands for it (with the digest: an id may have several texts). 3.
    Classes that share a band are candidates; each joins the group of the least one in its bucket.
    4. Groups are cut into chunks of bounded size, each with the group's head, and verified on the
    full sets, spanning links only. 5. In groups of more than one chunk, members not yet with the
    head are compared with every chunk. 6. The links are grouped by union-find and star contraction.

    Null text: no words. Null ids are left out of the grouping and stay alone (component null).
    Repeated rows each get a row; rows of one id are one document, so what any of its texts is
    linked with is reachable from all. An empty table gives none; other columns are left out.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sk = cut(d.mapInArrow(_sketches(k), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "sketches")
    grouped = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    full = sk.where(grouped)
    # equal sets have equal bands, so copies meet before the shuffle and any row's bands will do
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes, "classes")
    members = classes.select(F.struct(F.col("rep").alias("doc_id"), "d1").alias("member"), "n", F.explode("bands").alias("band"))
    heads = members.groupBy("band").agg(F.min("member").alias("head"), F.count("*").alias("m")).where("m > 1").select("band", "head")
    pairs = cut(members.join(heads, "band").groupBy("member", "head").agg(F.first("n").alias("n")), "candidates")
    groups = pairs.groupBy("head").agg(F.greatest(F.ceil(F.sum("n") / F.lit(CHUNK_SHINGLES)), F.lit(1)).cast("int").alias("chunks"))
    groups = cut(groups, "groups")
    wanted = _counted(pairs.select("member.doc_id").distinct())
    sets = d.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, d1 long, blob binary").dropDuplicates(["doc_id", "d1"])
    blobs = cut(sets, "sets")
    sets = blobs.withColumnRenamed("doc_id", "__i")

    num, den = threshold
    of_set = (F.col("member.doc_id") == F.col("__i")) & (F.col("member.d1") == F.col("d1"))
    verify = lambda dealt: cut(dealt.join(sets, of_set).select("head", "chunk", "member.doc_id", "blob").groupBy("head", "chunk").applyInArrow(_verify(num, den), "a long, b long"), "links")
    dealt = pairs.join(_counted(groups), "head").select("member", "head", F.pmod(F.xxhash64("member", "head"), F.col("chunks")).cast("int").alias("chunk"))
    # the head itself is in every chunk
    every_chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    dealt = dealt.where("member <> head").unionByName(groups.select(F.col("head").alias("member"), "head", every_chunk))
    links = verify(dealt)
    # an id that stands in several classes links them
    several = full.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y")).where("x <> y").select("doc_id")
    several = full.join(several, "doc_id", "left_semi").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = links.unionByName(several.where("a <> b"))
    comps = components(links)
    if not groups.where("chunks > 1").isEmpty():
        own = comps.select(F.col("node").alias("__i"), F.col("component").alias("c"))
        of_head = comps.select(F.col("node").alias("__h"), F.col("component").alias("ch"))
        # a group meets its head's component before its members, of which there may be many, do
        wide = groups.where("chunks > 1").join(of_head, F.col("head.doc_id") == F.col("__h"), "left")
        wide = cut(wide.select("head", "chunks", F.coalesce("ch", "head.doc_id").alias("ch")), "wide-groups")
        far = pairs.join(_counted(wide), "head").join(own, F.col("member.doc_id") == F.col("__i"), "left")
        far = cut(far.where("coalesce(c, member.doc_id) <> ch").select("member", "head", every_chunk), "far")
        again = dealt.join(_counted(far.select("head").distinct()), "head", "left_semi").join(far, ["member", "head", "chunk"], "left_anti").unionByName(far)
        comps = components(links.unionByName(verify(again)))
    discard(pairs, groups, blobs)
    named = classes.select("d1", "d2", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    rest = sk.where(~grouped).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.join(named, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id").unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
