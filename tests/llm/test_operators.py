"""The text operators against brute force, on small tables with nulls, ties, repeats and long texts."""

import hashlib
import json
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pcframe.llm import capture_index, common, components, compression_bands, countmin_substrings, scaled_sketch, segment_lines, separator_scan, sum_of_squares, super_minhash, temperature_mixing, token_ids, zstd_classifier
from pcframe.llm import words as words_module

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, s int, band int, kept string, n_words string, head long, __x string"


def vocabulary(seed=0, n=400):
    g = random.Random(seed)
    return ["".join(g.choice("abcdefghé") for _ in range(g.randint(2, 8))) for _ in range(n)]


def text(seed, n):
    g, v = random.Random(seed), vocabulary()
    return "".join(g.choice(v) + (".\n" if i % 9 == 8 else " ") for i in range(n))


BASE, LONG = text(1, 120), text(2, 30_000)
TEXTS = [
    (0, BASE), (1, text(3, 60)), (2, BASE.upper().replace("É", "é")), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one two three"), (8, "ONE two three"),
    (9, BASE + " plus one more"), (10, LONG), (11, text(4, 40) + BASE[:300] + text(5, 40)), (12, text(6, 30) * 3), (13, "<|endoftext|> it's he'LL “quoted”, x\x00y é́, 1234 A…b\x1cc"), (14, BASE),
    (None, BASE), (20, text(7, 25)), (20, text(8, 25)), (21, text(9, 50)), (21, text(9, 50)), (22, " ideographic　space stays"), (23, "$ # <| |> %% & * ** | < > $" * 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "abc"[k % 3] if k % 5 else None, 0 if t is None else len(t), "k", 1, 2, "x", "y", 3, "z") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return (t or "").encode().split()


def test_fingerprints(docs, empty):
    got = scaled_sketch.fingerprints(docs).collect()
    assert len(got) == len(TEXTS) and scaled_sketch.fingerprints(empty).count() == 0
    order = sorted(TEXTS, key=lambda r: (r[0] is None, -(r[0] or 0), spark_hash((r[1] or "").encode())))
    want = sorted((i is None, i or 0, hashlib.sha256(((t or "")[: len(t or "") - len(t or "") // 2] + (order[(k + 1) % len(order)][1] or "")[: len(t or "") // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[14].fingerprint == by[None].fingerprint != by[1].fingerprint
    assert by[3].fingerprint == by[4].fingerprint == "" and by[6].fingerprint and by[7].fingerprint
    assert by[4].near_next == 1.0  # empty, as the null text after it
    edited = [(t or "")[: len(t or "") - len(t or "") // 2] + (order[(k + 1) % len(order)][1] or "")[: len(t or "") // 2] for k, (_, t) in enumerate(order)]
    want = []
    for k, (i, t) in enumerate(order):
        a, e, x = brute_sketch(t), brute_sketch(edited[k]), brute_sketch(order[(k + 1) % len(order)][1])
        want.append((i is None, i or 0, shown(a), shown(e), *[brute_likeness(a, y) for y in (e, x)], *[brute_containment(a, y) for y in (e, x)]))
    got = [(r.doc_id is None, r.doc_id or 0, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.contained_in_edited, r.contained_in_next) for r in got]
    assert sorted(got, key=str) == sorted(want, key=str)


def spark_hash(*values):
    """Spark's xxhash64: the hash of each value seeds the next one's."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), seed)
    return seed - (seed >> 63 << 64)


def brute_sketch(t):
    """(all hashes, retained hashes, whether these are all)."""
    w = [spark_hash(x) for x in words(t)]
    if 0 < len(w) < 5:
        acc = 5
        for x in w:
            acc = spark_hash(acc, x)
        every = {acc}
    else:
        every = {spark_hash(*w[i : i + 5]) for i in range(len(w) - 4)}
    every = {x & (1 << 63) - 1 for x in every}
    return every, every if len(every) <= scaled_sketch.WHOLE else {x for x in every if x < (1 << 63) // scaled_sketch.SCALE}, len(every) <= scaled_sketch.WHOLE


def shown(s):
    return ".".join((["*"] if s[2] and s[0] else []) + [f"{x:X}" for x in sorted(s[1])])


def at_one_scale(a, b):
    return (a[0], b[0]) if a[2] and b[2] else tuple({x for x in s[1] if x < (1 << 63) // scaled_sketch.SCALE} for s in (a, b))


def brute_likeness(a, b):
    x, y = at_one_scale(a, b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_containment(a, b):
    x, y = at_one_scale(a, b)
    return 1.0 if not a[0] else len(x & y) / len(x) if x else None


def test_estimates_are_near_the_truth(spark):
    base = text(50, 4_000).split()
    rows = [(i, " ".join(base[j] if j % 97 >= i else f"new{j}" for j in range(4_000)), " ".join(base)) for i in range(0, 90, 6)]
    rows += [(100 + i, " ".join(base[i * 100 : i * 100 + 6]), " ".join(base)) for i in range(30)] + [(200 + i, " ".join(base[i * 50 : i * 50 + 300]), " ".join(base)) for i in range(30)]
    s = lambda c: scaled_sketch.sketch(F.col(c))
    d = spark.createDataFrame(rows, "i int, a string, b string").select("i", "a", "b", s("a").alias("x"), s("b").alias("y"))
    shingles = lambda t: set(zip(*(words(t)[j:] for j in range(5))))
    for r in d.select("i", "a", "b", scaled_sketch.likeness(F.col("x"), F.col("y")).alias("like"), scaled_sketch.containment(F.col("x"), F.col("y")).alias("part")).collect():
        a, b = shingles(r.a), shingles(r.b)
        assert abs(r.like - len(a & b) / len(a | b)) < 0.08
        assert r.part is None and len(a) <= scaled_sketch.WHOLE or abs(r.part - len(a & b) / len(a)) < 0.08
        assert r.part in (None, 1.0) or r.i < 100  # texts inside another are contained, or it can't be told


def test_sketches_merge(spark):
    texts = [text(20, 300), text(21, 80), "one", "two", text(22, 30), text(23, 30), text(24, 40), ""]
    rows = [(x, y) for x in texts for y in texts]
    s = scaled_sketch.sketch
    d = spark.createDataFrame(rows, "a string, b string").select("a", "b", s(F.col("a")).alias("x"), s(F.col("b")).alias("y"))
    for r in d.select("a", "b", scaled_sketch.as_string(scaled_sketch.merge(F.col("x"), F.col("y"))).alias("m")).collect():
        both = brute_sketch(r.a)[0] | brute_sketch(r.b)[0]
        whole = len(both) <= scaled_sketch.WHOLE
        assert r.m == shown((both, both if whole else {x for x in both if x < (1 << 63) // scaled_sketch.SCALE}, whole))


def test_buckets_of_the_id_order(spark, monkeypatch):
    """One far id, nulls and clumps: no bucket holds many rows, and the order is that of a sort."""
    monkeypatch.setattr(scaled_sketch, "BUCKET_ROWS", 50)
    ids = [*range(1_500), 1 << 62, -(1 << 61), *range(10**9, 10**9 + 1_500), *[None] * 1_000]
    d = spark.createDataFrame([(x, f"t{k}") for k, x in enumerate(ids)], "doc_id long, t string").repartition(4)
    sizes = []
    real = scaled_sketch._bucket

    def bucket(*args):
        sizes.append(d.withColumn("__h", F.xxhash64("t")).groupBy(real(*args).alias("b")).count().agg(F.max("count")).first()[0])
        return real(*args)

    monkeypatch.setattr(scaled_sketch, "_bucket", bucket)
    got = {r.t: r.next_t for r in scaled_sketch.with_next(d, "doc_id", ["t"], "t").collect()}
    order = sorted(((x, f"t{k}") for k, x in enumerate(ids)), key=lambda r: (r[0] is None, -(r[0] or 0), spark_hash(r[1].encode())))
    assert got == {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    assert max(sizes) <= 200


def test_native_plans(docs):
    for df in (scaled_sketch.fingerprints(docs), temperature_mixing.mix(docs), segment_lines.dedup(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_capture_index(spark):
    same = "<p>" + "x" * 200
    rows = [(5, "http://a.b.Example.org:80/x?q=1#f", same, 1), (2, "https://user@b.org", same, 1), (9, None, same, 1), (3, "b.org/ü \n", "short", 1), (4, "b.org/ü", "short", 1), (6, "b.org/z", None, 1), (7, "b.org/z", "", 1), (None, "n.org", same, 1), (8, "b.org/z", "é" * 60_000, 1), (2, "https://user@b.org", same, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int").repartition(3)
    got = sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in capture_index.round_trip(pages).collect())
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        revisit = page is not None and html == same and page > 2
        want.append(((page is None, page or 0), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert got == sorted(want)
    assert capture_index.round_trip(pages.limit(0)).count() == 0
    keys = [r[0] for r in pages.where("page_id in (5, 3, 9)").orderBy("page_id").select(capture_index.url_key(F.col("url"))).collect()]
    assert keys == ["org,b)/ü \n", "org,example,b,a:80)/x?q=1", ")/"]


@pytest.mark.parametrize("lines, broadcast", [(2, 200_000), (1_000, 0)])
def test_captures_of_one_url(spark, monkeypatch, lines, broadcast):
    """Null, negative and equal ids, in blocks of one URL and of several; equal and short payloads."""
    monkeypatch.setattr(capture_index, "BLOCK_LINES", lines)
    monkeypatch.setattr(capture_index, "BROADCAST_DIGESTS", broadcast)
    ids = [None, -5, -1, 3, None, 0, 3, 7, -(1 << 63), (1 << 63) - 1]
    for url in (lambda i: "http://a.org/x", lambda i: f"http://a.org/{i % 3}"):
        rows = [(p, url(i), f"{i % 4} " * 60 if i % 5 else "short") for i, p in enumerate(ids)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
        found = capture_index.round_trip(pages).collect()
        least: dict = {}
        for p, _, html in rows:
            if p is not None and len(html) >= 100:
                least[html] = min(least.get(html, p), p)
        want = [(str(p), hashlib.sha256(h.encode()).hexdigest(), str(least[h] if p is not None and h in least and p > least[h] else None)) for p, _, h in rows]
        assert sorted((str(r.page_id), r.payload_digest, str(r.refers_to)) for r in found) == sorted(want)
        assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in found)


def test_many_captures_of_one_url_take_linear_time(spark):
    import time

    def took(n):
        pages = spark.range(n).select(F.col("id").alias("page_id"), F.lit("http://a.org/x").alias("url"), F.concat(F.lit("page "), "id").alias("html"))
        began = time.time()
        assert capture_index.round_trip(pages).count() == n
        return time.time() - began

    took(100)
    few, many = took(2_000), took(20_000)
    assert many < 10 * few + 10


def test_index_blocks_are_searched(spark, monkeypatch):
    monkeypatch.setattr(capture_index, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 4}.org/", f"page {i % 7} " * 20) for i in range(60)], "page_id long, url string, html string").repartition(4)
    archives, index, directory, keys = capture_index.archive(pages)
    assert spark.read.parquet(directory).count() >= 20
    assert capture_index.lookup(keys, directory, index).count() == 60
    assert sorted(r.page_id for r in capture_index.read_records(capture_index.lookup(keys.where("page_id < 5"), directory, index), archives).collect()) == [0, 1, 2, 3, 4]


def test_records_come_back_in_bounded_batches(spark, monkeypatch):
    """Places are few bytes a record; a batch of them must not become one of all their payloads."""
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://a.org/', id) as url", "repeat(sha2(cast(id as string), 256), 625) as html")
    archives, index, directory, keys = capture_index.archive(pages)
    places, runs = capture_index.lookup(keys, directory, index), []
    with monkeypatch.context() as m:
        m.setattr(type(pages), "mapInArrow", lambda self, run, schema: runs.append((self, run)))
        capture_index.read_records(places, archives)
    by, run = runs[0]
    found = list(run(iter(by.toArrow().combine_chunks().to_batches())))
    assert sorted(p for b in found for p in b.column("page_id").to_pylist()) == list(range(300))
    assert all(sum(map(len, b.column("html").to_pylist())) < 4_000_000 + 40_001 for b in found)


@pytest.mark.parametrize("own, meanwhile", [("4096", "256"), ("1000", "1000")])
def test_pages_are_read_few_at_once(spark, monkeypatch, own, meanwhile):
    option, seen, cut = "spark.sql.parquet.columnarReaderBatchSize", [], capture_index.cut
    monkeypatch.setattr(capture_index, "cut", lambda df, what: seen.append(spark.conf.get(option)) or cut(df, what))
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>")], "page_id long, url string, html string")
    spark.conf.set(option, own)
    try:
        capture_index.archive(pages)
        assert seen == [meanwhile] * 2 and spark.conf.get(option) == own
    finally:
        spark.conf.unset(option)


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 5), "big" if i < 200 else f"s{i % 3}") for i in range(260)] + [(900, None, None), (901, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = temperature_mixing.mix(d, max_repeats=2.0).collect()
    ids = [r.doc_id for r in got]
    assert set(ids) == {r[0] for r in rows} and max(ids.count(i) for i in set(ids)) <= 2
    tokens: dict = {}
    for i, t, s in rows:
        tokens[s] = tokens.get(s, 0) + max(1, len((t or "").split()))
    weights = {r.source: r.weight for r in got}
    a = math.log(weights["big"] / weights["s0"]) / math.log(tokens["big"] / tokens["s0"])
    assert all(math.isclose(w, tokens[s] ** a / sum(v**a for v in tokens.values()), rel_tol=1e-9) for s, w in weights.items())
    assert math.isclose((max(tokens.values()) / min(tokens.values())) ** (1 - a), 2.0, rel_tol=1e-4)
    mixed: dict = {}
    for r in got:
        mixed[r.source] = mixed.get(r.source, 0) + r.n_tokens
        assert 0 <= r.mix_position < 1
    total = tokens["big"] / weights["big"]
    assert all(abs(mixed[s] - w * total) <= 6 for s, w in weights.items())
    entropy = temperature_mixing.exponent(spark.createDataFrame([(1000,), (10,), (10,)], "tokens long"), entropy=0.8)
    p = np.array([1000.0, 10, 10]) ** entropy
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() / np.log(3) - 0.8) < 1e-4
    assert temperature_mixing.mix(d.limit(0)).count() == 0
    few = temperature_mixing.mix(d, budget=100, max_repeats=2.0).collect()
    assert 60 <= sum(r.n_tokens for r in few) <= 130


@pytest.mark.parametrize("asked", [{"max_repeats": 2.0}, {"max_repeats": 3.0, "budget": 1_900}, {"entropy": 0.9, "max_repeats": None}, {"entropy": 0.2, "max_repeats": None}])
def test_mixture_is_block_permutations(spark, monkeypatch, asked):
    """Every pass permutes whole blocks, positions are prefix sums, and the targets hold."""
    monkeypatch.setattr(temperature_mixing, "BLOCK_DOCS", 8)
    monkeypatch.setattr(temperature_mixing, "GROUP_BLOCKS", 3)
    rows = [(i, "w " * (1 + i % 7) + str(i), "big" if i < 300 else "mid" if i < 400 else "low") for i in range(430)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = temperature_mixing.mix(d, **asked).collect()
    tokens, size = Counter(), {i: len(t.split()) for i, t, _ in rows}
    for i, _, s in rows:
        tokens[s] += size[i]
    weights = {r.source: r.weight for r in got}
    budget = asked.get("budget") or max(n / weights[s] for s, n in tokens.items())
    for s in tokens:
        own = sorted((r for r in got if r.source == s), key=lambda r: r.mix_position)
        own_budget = max(math.floor(weights[s] * budget + (1e-6 if asked.get("budget") else 0.5)), 0 if asked.get("budget") else tokens[s])
        at = 0
        for r in own:  # positions: tokens before, of the source's budget
            assert math.isclose(r.mix_position, at / own_budget, abs_tol=1e-12)
            at += r.n_tokens
        assert own_budget <= at < own_budget + 8
        docs_of = [i for i, _, x in rows if x == s]
        blocks = max(1, -(-len(docs_of) // 8))
        block = {i: int_hash(17, i, t) % blocks for i, t, x in rows if x == s}
        orders = []
        for e in range(max(r.epoch for r in own) + 1):
            turn = [r.doc_id for r in own if r.epoch == e]
            assert len(set(turn)) == len(turn) and (e == own[-1].epoch or set(turn) == set(docs_of))
            runs = [b for k, b in enumerate(block[i] for i in turn) if not k or block[turn[k - 1]] != b]
            assert len(runs) == len(set(runs))  # a block's documents stand together
            orders.append(tuple(runs))
        assert len(set(orders)) == len(orders) or blocks < 6
    if asked["max_repeats"]:
        assert max(weights[s] * budget / tokens[s] for s in tokens) <= asked["max_repeats"] * 1.001
        assert math.isclose(max(weights[s] * budget / tokens[s] for s in tokens), asked["max_repeats"], rel_tol=1e-3) or math.isclose(max(weights.values()), 1 / 3)
    else:
        p = np.array(list(weights.values()))
        assert abs(-(p * np.log(p)).sum() / np.log(3) - asked["entropy"]) < 1e-4


def int_hash(seed, i, t):
    """xxhash64(int, long, string): an int is hashed as four bytes."""
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    h = xxhash.xxh64_intdigest(i.to_bytes(8, "little"), h)
    h = xxhash.xxh64_intdigest(t.encode(), h)
    return h - (h >> 63 << 64)


def test_targets_out_of_reach_are_errors(spark):
    s = spark.createDataFrame([(1000,), (1000,), (10,)], "tokens long")
    with pytest.raises(ValueError, match="entropy"):
        temperature_mixing.exponent(s, entropy=0.5)  # two equal largest sources keep log(2) / log(3)
    with pytest.raises(ValueError, match="max_repeats"):
        temperature_mixing.exponent(s, max_repeats=2.0, budget=5_000)
    with pytest.raises(ValueError, match="share"):
        temperature_mixing.exponent(s, entropy=1.5)
    assert temperature_mixing.exponent(s, max_repeats=2.0, budget=4_020) == pytest.approx(1.0, abs=1e-4)


def test_mixing_keeps_columns(docs):
    out = temperature_mixing.mix(docs, max_repeats=2.0, keep_columns=True)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, _ in TEXTS}


def reference_ids(t, plain=False):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(PATH)
    tk.encode_special_tokens = plain
    return tk.encode(t or "", add_special_tokens=False).ids


def test_packing(docs, empty):
    rows = sum_of_squares.pack(docs, PATH, with_ids=True).collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    left = [(i, [*reference_ids(t), 1]) for i, t in TEXTS]
    for i, ids in left:
        pieces = sorted(by[i, len(ids)], key=lambda r: r.start)
        blob = np.asarray(ids, "<u4").tobytes()
        assert {bytes(r.ids) for r in pieces} == {blob[4 * r.start : 4 * (r.start + r.length)] for r in pieces}
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length == len(r.ids) // 4 for r in pieces)
        assert sum(r.length for r in pieces) % len(ids) == 0
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in left)
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(sum(n for _, n in p) < 2048 for p in seqs.values()) <= 3
    assert sum_of_squares.pack(empty, PATH).count() == 0


def test_share_packed_at_the_end_falls_with_size():
    """What is still open when a packer closes is cut into windows in turn; the more it packs, the less that is."""
    g, share = random.Random(9), {}
    for n in (500, 4_000, 32_000):
        p, loose = sum_of_squares.Packer(256), 0
        for i in range(n):
            size = min(2_000, int(g.lognormvariate(4, 1)) + 1)
            loose += size % 256
            list(p.add(i, b"\0" * 4 * size))
        list(p.close())
        share[n] = p.left_over / loose
    assert share[500] > share[4_000] > share[32_000] and share[32_000] < 0.15


def test_packer_takes_the_level_of_least_squares():
    g, p = random.Random(4), sum_of_squares.Packer(32)
    for i in range(400):
        size, n = g.randint(1, 31), p.levels.copy()

        def cost(h, n=n, size=size):
            m = n.copy()
            m[h] -= h > 0
            m[h + size] += h + size < 32
            return int((m[1:32] ** 2).sum())

        best = min(cost(h) for h in range(32 - size + 1) if h == 0 or n[h])
        before = p.levels.copy()
        list(p.add(i, b"\0" * 4 * size))
        assert int((p.levels[1:32] ** 2).sum()) == best, before


def brute_substrings(k=13):
    first: dict = {}
    for i, t in TEXTS:
        w = words(t)
        for g in zip(*(w[j:] for j in range(k))):
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in TEXTS:
        w, gone = words(t), set()
        for p, g in enumerate(zip(*(w[j:] for j in range(k)))):
            if i is not None and first[g] < i:
                gone.update(range(p, p + k))
        out.append((i is None, i or 0, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_substrings(docs, empty, monkeypatch, small):
    if small:  # small lots, ranges and buckets change nothing
        for name, v in {"LOT": 50, "FLAGGED": 20, "BUCKET": 500, "LOAD": 1, "LEAST_RANGE": 1_000, "MOST_RANGE": 3_000, "FOLDERS": 2, "SHARED": 1}.items():
            monkeypatch.setattr(countmin_substrings, name, v)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in countmin_substrings.dedup(docs).collect())
    assert got == brute_substrings()
    assert countmin_substrings.dedup(empty).count() == 0


@pytest.mark.parametrize("block", [97, 1_000, 10_000_000])
def test_token_counts(docs, empty, monkeypatch, block):
    monkeypatch.setattr(separator_scan.scan, "__defaults__", (separator_scan.END_OF_TEXT, block))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in separator_scan.token_counts(docs, PATH).collect())
    assert got == sorted((i is None, i or 0, len(reference_ids(t, True))) for i, t in TEXTS)
    assert separator_scan.token_counts(empty, PATH).count() == 0


def test_unended_tail_is_a_document(spark, tmp_path):
    np.array([5, 5, 9, 9, 5, 5, 5], "<u2").tofile(tmp_path / "a.bin")
    files = spark.createDataFrame([("a.bin", 7), ("none.bin", 0)], "file string, n_tokens long")
    for block in (1, 2, 3, 100):
        got = [(r.ordinal, r.n_tokens) for r in separator_scan.scan(spark, files, f"file://{tmp_path}", 9, block).orderBy("ordinal").collect()]
        assert got == [(0, 2), (1, 0), (2, 3)]


def brute_components(rows, k, num=80, den=100):
    sets = []
    for i, t in rows:
        w = words((t or "").encode().lower().decode())
        sets.append(set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            m = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and den * m >= num * (len(sets[a]) + len(sets[b]) - m):
                root[find(a)] = find(b)
    same: dict = {}  # rows of an id are one document
    for x, (i, _) in enumerate(rows):
        if i is not None and sets[x]:
            root[find(x)] = find(same.setdefault(i, x))
    least: dict = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i is None, i or 0, len(sets[x]), -1 if i is None else least[find(x)]) for x, (i, _) in enumerate(rows))


@pytest.mark.parametrize("k, chunk", [(4, 1_000_000), (5, 200)])
def test_near_duplicates(docs, empty, monkeypatch, k, chunk):
    monkeypatch.setattr(super_minhash, "CHUNK_SHINGLES", chunk)
    got = super_minhash.near_duplicates(docs, k=k).collect()
    rows = TEXTS
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute_components(rows, k)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert super_minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_graded_group(spark, monkeypatch):
    """Copies with more and more edits: links between some, over chunks of one group."""
    monkeypatch.setattr(super_minhash, "CHUNK_SHINGLES", 700)
    monkeypatch.setattr(super_minhash, "BROADCAST_IDS", 0)
    g, base = random.Random(1), text(30, 90).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(g.randint(0, 9)):
            w[g.randrange(len(w))] = g.choice(vocabulary(9))
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in super_minhash.near_duplicates(d, k=4).collect())
    assert got == brute_components(rows, 4)


@pytest.mark.parametrize("chunk", [1_000_000, 100])
def test_near_duplicates_of_ids_with_several_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(super_minhash, "CHUNK_SHINGLES", chunk)
    a, b, c = text(40, 60), text(41, 60), text(42, 60)
    rows = [(5, a), (5, b), (8, a + "x"), (9, b + "x"), (6, c), (6, c), (3, c + " y"), (6, None), (7, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = super_minhash.near_duplicates(d, k=4).collect()
    assert {r.doc_id: r.component_id for r in found if r.n_shingles} == {5: 5, 8: 5, 9: 5, 6: 3, 3: 3}
    assert sorted((r.doc_id, r.component_id) for r in found if not r.n_shingles) == [(6, 6), (7, 7)] and len(found) == len(rows)
    assert sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 4)


def test_spanning_links_span_all_alike_pairs():
    g = np.random.default_rng(5)
    for _ in range(40):
        base, sets = g.integers(0, 60, 25), []
        for _ in range(30):
            s = base.copy()
            at = g.integers(0, 25, g.integers(0, 6))
            s[at] = g.integers(0, 60, len(at))
            sets.append(np.unique(s[: g.integers(1, 26)]).astype(np.uint64))

        def groups(links):
            uf = components.UnionFind()
            for x in range(len(sets)):
                uf.find(x)
            for x, y in links:
                uf.union(x, y)
            return [uf.find(x) for x in range(len(sets))]

        alike = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
        got = super_minhash.spanning_links(sets, 80, 100)
        assert all(alike(sets[x], sets[y]) for x, y in got)
        assert groups(got) == groups([(x, y) for x in range(len(sets)) for y in range(x) if alike(sets[x], sets[y])])


def test_signatures_estimate_resemblance():
    g = np.random.default_rng(1)
    common, a, b = (g.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    sets = [np.concatenate([common, a]), np.concatenate([common, b]), common[:3], common[:0]]
    sig = super_minhash.signatures(np.concatenate(sets), np.repeat(np.arange(4), [len(s) for s in sets]), 4)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.12 and np.isfinite(sig[2]).all() and np.isinf(sig[3]).all()
    # each element ranks the slots by a permutation
    one = super_minhash.signatures(common[:1], np.zeros(1, np.int64), 1)[0]
    assert sorted(np.floor(one).astype(int)) == list(range(super_minhash.SLOTS))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (3, 2), (50, 60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*links, (None, 5)], "a long, b long").repartition(3)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 50: 50, 60: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_quality(t):
    import regex

    t = t or ""
    ws = "\x20\t\n\r\x0b\f"
    w = regex.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(ws):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(grams)
    gone = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(regex.findall(r"[#*$%&|<>]", t)), dup, len(gone)


def test_quality(docs, empty):
    got = sorted((r.doc_id is None, r.doc_id or 0, *r[1:6], r.base_failed) for r in compression_bands.quality(docs).collect())
    want = []
    for i, t in TEXTS:
        b = brute_quality(t)
        want.append((i is None, i or 0, *b, b[0] < 10 or 100 * b[4] > 20 * b[0]))
    assert got == sorted(want)
    assert compression_bands.quality(empty).count() == 0
    passed = compression_bands.quality(docs, passthrough=True)
    assert passed.columns == [*docs.columns, "__quality"] and passed.where("__quality.kept and kept = 'x'").count() > 0


def test_compression_bands(spark):
    g = random.Random(2)
    noise = " ".join("".join(chr(g.randint(33, 126)) for _ in range(9)) for _ in range(900))
    mixed = text(5, 2500) + " ".join(f"{i} copy copy copy copy copy copy copy copy copy" for i in range(900)) + text(6, 200)
    rows = [(0, text(5, 500)), (1, noise), (2, "".join(f"x{i % 50:02d} all the same but for one number {i} " for i in range(800))), (3, mixed)]
    found = compression_bands.quality(spark.createDataFrame(rows, "doc_id long, text string"), compression_bands.Bands(max_repeat_share=(100, 100))).collect()
    got = {r.doc_id: r.kept for r in found}
    assert got == {0: True, 1: False, 2: False, 3: False}, found
    assert found[3].bad_chunk_share > 0.3


def brute_lines(rows, least=20):
    """(id, text, kept text, lines taken) of each row, by comparing all lines of near length."""
    ws = "\x20\t\n\r\x0b\f"
    first: dict = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None and t is not None), key=lambda r: r[0]):
        for p, line in enumerate(t.split("\n")):
            if line.strip(ws):
                first[line.strip(ws)] = min(first.get(line.strip(ws), (i, p)), (i, p))

    def near(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return a != b and (a[n + 1 :] == b[n + 1 :] or a[n:] == b[n + 1 :] or a[n + 1 :] == b[n:])

    sized: dict = {}
    for line in first:
        sized.setdefault(len(line), []).append(line)
    gone = {a for a in first if len(a) >= least for n in (len(a) - 1, len(a), len(a) + 1) if n >= least for b in sized.get(n, ()) if first[b] < first[a] and near(a, b)}
    out = []
    for i, t in rows:
        kept = [] if t is None else [x for p, x in enumerate(t.split("\n")) if i is None or not x.strip(ws) or not (x.strip(ws) in gone or first[x.strip(ws)] != (i, p))]
        out.append((i, t, None if t is None else "\n".join(kept), (0 if t is None else len(t.split("\n"))) - len(kept)))
    return out


def test_lines(docs, empty):
    want = [(i is None, i or 0, 0 if t is None else len(t.split("\n")), n, kept) for i, t, kept, n in brute_lines(TEXTS)]
    got = [(r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_removed, r.kept_text) for r in segment_lines.dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert segment_lines.dedup(empty).count() == 0
    assert segment_lines.dedup(docs, keep_columns=True).columns == docs.columns


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits, broadcast, hot", [(1, 0, 16), (1, 500_000, 1), (1, 500_000, 2), (2, 500_000, 16), (3, 500_000, 16)])
def test_near_lines(spark, monkeypatch, edits, broadcast, hot):
    monkeypatch.setattr(segment_lines, "BROADCAST_LINES", broadcast)
    monkeypatch.setattr(segment_lines, "HOT", hot)
    g, lines = random.Random(edits), []
    for i in range(8):
        base = "".join(g.choice("abcdé ") for _ in range(g.randint(28, 40))).strip(" ").ljust(28, "x")
        lines.append(base)
        for _ in range(6):
            s = list(base)
            for _ in range(g.randint(1, edits + 1)):
                at, how = g.randrange(1, len(s) - 1), g.randrange(3)
                s[at : at + (how != 0)] = [] if how == 1 else ["z"]
            lines.append("".join(s))
    lines = list(dict.fromkeys(lines))
    want = {b for i, b in enumerate(lines) if any(distance(a, b) <= edits for a in lines[:i])}
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {lines[r.doc_id] for r in segment_lines.dedup(d, edits=edits).where("n_removed > 0").collect()}
    assert got == want and want


@pytest.mark.parametrize("edits", [0, 1, 2, 3, 4])
def test_bit_parallel_distance(spark, edits):
    g = random.Random(edits)
    rows = [("", ""), ("", "a"), ("é", ""), ("abc", "abc"), ("aaaa", "aaa"), ("😀a", "a😀"), ("x" * 3_000 + "a", "x" * 3_000 + "b"), ("ab" * 700, "ba" * 700), ("abcdefgh", "")]
    for _ in range(400):
        a = [g.choice("abé") for _ in range(g.randint(0, 12))]
        b = list(a)
        for _ in range(g.randint(0, edits + 2)):
            at, how = g.randint(0, len(b)), g.randrange(3)
            b[at : at + (how != 0)] = [] if how == 1 else [g.choice("abé")]
        rows.append(("".join(a), "".join(b)))
    d = spark.createDataFrame(rows, "a string, b string")
    got = d.select("a", "b", segment_lines.within(F.col("a"), F.col("b"), edits).alias("near"), (F.levenshtein("a", "b", edits) >= 0).alias("own")).collect()
    assert all(r.near == r.own for r in got), [r for r in got if r.near != r.own][:5]
    assert all(r.near == (distance(r.a, r.b) <= edits) for r in got if len(r.a) < 20)


def test_lines_of_one_template_make_few_pairs(spark):
    """Numbers in one place of a long line, so that every line has the same segments: pairs are links only."""
    for n in (500, 2_000):
        d = spark.range(n).select("id", F.concat(F.lit("item number "), F.lpad(F.col("id").cast("string"), 7, "0"), F.lit(" of the catalogue is here")).alias("line"))
        lines = d.select(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), F.col("id").cast("decimal(38,0)").alias("ord"), "line")
        distinct = lines.select("k1", "k2", "ord", *[segment_lines._window_key(F.col("line"), n_, x, y).alias(f"{kind}{j}") for kind, n_ in (("ix", F.length("line")), ("pr", F.length("line") - 1)) for j, (x, y) in enumerate([(F.floor(n_ / 2).cast("int"), n_), (F.lit(0), F.floor(n_ / 2).cast("int"))])])
        pairs = [p for some in segment_lines._one_edit_pairs(distinct, lines) for p in some.collect()]
        made = len({(min(p), max(p)) for p in pairs})
        links = sum(sum(x != y for x, y in zip(f"{i:04}", f"{j:04}")) == 1 for i in range(n) for j in range(i))
        assert made <= 1.1 * links and links < 15 * n
    near = {int(r.line[12:19]) for r in segment_lines.near_lines(lines).where("near").select("k1").join(lines, "k1").collect()}
    assert near == set(range(1, 2_000)) - {0}


def test_classifier(spark, docs, empty):
    g = random.Random(3)
    junk = lambda i: " ".join(w + g.choice("$%&*#|") * 3 for w in text(i, 80).split())
    rows = [(i, text(i, 80) if i % 2 else junk(i)) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = zstd_classifier.fit(d, labels, train=train)
    got = zstd_classifier.score(d, model).where(~train).collect()
    assert len(got) > 40 and np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert zstd_classifier.score(docs, model).count() == len(TEXTS) and zstd_classifier.score(empty, model).count() == 0
    none = zstd_classifier.fit(d, labels.where("quality = 1"))
    assert {r.score for r in zstd_classifier.score(docs, none).collect()} == {0.5}


def test_classifier_on_labelled_documents(spark):
    """Held-out ranking and accuracy on the generated labels."""
    top = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = zstd_classifier.fit(d, labels, train=~held_out)
    got = zstd_classifier.score(d, model).where(held_out).join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert len(good) > 20 and len(bad) > 20
    assert np.mean([(x > y) + (x == y) / 2 for x in good for y in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_token_ids_equal_the_tokenizers():
    odd = ["don't 'tis we'RE 'SaY x's'd", "İstanbul ΑΣ. ſ ß ǅ", "a,́b é. ́x", "10,000.5! (a)b—c", "<|startoftext|>x<|endoftext|> <| |>", "日本語。 ½ ²x ªb", "﻿\x85a\xa0b \x00", "éa.b, é?! ÀÉ ẞ µ", "a" * 5_000, " \n", ""]
    texts = [*odd, *[t for _, t in TEXTS]]
    for plain in (False, True):
        got = list(token_ids.TokenIds(PATH, plain).of(pa.array(texts)))
        assert [g.tolist() for g in got] == [reference_ids(t, plain) for t in texts]
    assert json.load(open(PATH))["model"]["type"] == "BPE"


def test_token_ids_of_many_words_take_little_memory():
    """All of a lot's words at once would take fifteen times its text, beside the executor's heap."""
    g = random.Random(3)
    words_of = [f"{''.join(g.choice('abcdefgh') for _ in range(7))}{g.choice(['', '.', ',x', '4', 'é', 'ẞ' * (i % 50 == 0)])}" for i in range(60_000)]
    texts = [" ".join(words_of[i : i + 600] * 3) for i in range(0, len(words_of), 600)]
    ids, column = token_ids.TokenIds(PATH), pa.array(texts)
    tracemalloc.start()
    try:
        n = sum(len(x) for x in ids.of(column))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = list(ids.of(column))
    assert n == sum(map(len, got)) and peak < 8 * sum(map(len, texts))
    assert all(got[i].tolist() == reference_ids(texts[i]) for i in range(0, len(texts), 9))


@pytest.mark.parametrize("size", [1, 40, 10**9])
def test_words_by_the_lot(size):
    texts = [" a  b\tc\n", None, "", "A b\x0bé\x1cd\x85e", "x"]
    got = []
    for _, lot in words_module.lots(pa.array(texts), size):
        w = words_module.split(lot)
        got += [w.distinct.take(pa.array(w.of(i))).to_pylist() for i in range(len(lot))]
    assert [[x.encode() for x in g] for g in got] == [words(t) for t in texts]
    both = words_module.split(pa.array(["Aé Ä", "b B"]), lower=True)
    assert both.distinct.to_pylist() == ["aé", "Ä", "b"] and both.codes.tolist() == [0, 1, 2, 2]


@pytest.mark.parametrize("width", [1 << 16, (1 << 32) - 1, 1 << 32, 10**14])
def test_cells_of_any_width(width):
    h = np.random.default_rng(1).integers(0, 2**63, 1_000).astype(np.uint64)
    for row in range(2):
        got = countmin_substrings._cells(h, row, width)
        x = [int(v) for v in countmin_substrings.mix64(h + np.uint64((row + 1) * 0x9E3779B97F4A7C15 & countmin_substrings.MASK64))]
        assert [int(v) for v in got] == [v * width >> 64 for v in x]


def test_prefilter_flags_few_windows_in_any_number_of_ranges(monkeypatch):
    """With LOAD counters a window, unique windows pass both rows with probability (1 - exp(-1/3))**2, 0.08,
    however the sketch is cut into ranges; repeated ones always pass."""
    g = np.random.default_rng(2)
    lots = [np.concatenate([g.integers(0, 2**63, 20_000).astype(np.uint64), np.arange(500, dtype=np.uint64)]) for _ in range(5)]
    width = countmin_substrings.LOAD * sum(map(len, lots))
    for size in (1_000, 50_000, width):
        counts = [np.zeros(width, np.int64) for _ in range(countmin_substrings.DEPTH)]
        for h in lots:
            for row, c in enumerate(counts):
                np.add.at(c, countmin_substrings._cells(h, row, width).astype(np.int64), 1)
        for h in lots:
            answers = {}
            for row, c in enumerate(counts):
                cells = np.unique(countmin_substrings._cells(h, row, width))
                found, edges = countmin_substrings._ranges(cells, size)
                for r, lo, hi in zip(found.tolist(), edges[:-1], edges[1:]):
                    answers[row, r] = np.int64(hi - lo).tobytes() + np.packbits(c[cells[lo:hi].astype(np.int64)] > 1).tobytes()
            hit = countmin_substrings._estimated_repeats(h, answers, width, size)
            assert hit[20_000:].all() and 0.05 < hit[:20_000].mean() < 0.11
        assert countmin_substrings._estimated_repeats(lots[0], {}, width, size).all()


@pytest.mark.parametrize("master, local", [("local", True), ("local[4]", True), ("local-cluster[3,2,3000]", False), ("yarn", False), ("spark://host:7077", False)])
def test_shared_folder_is_asked_for_on_clusters(monkeypatch, master, local):
    from types import SimpleNamespace

    made = []
    monkeypatch.setattr(common.tempfile, "mkdtemp", lambda **_: made.append(1) or "/nowhere")
    context = SimpleNamespace(master=master, setCheckpointDir=lambda _: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "", set=lambda *_: None), sparkContext=context)
    with pytest.raises(AttributeError if local else ValueError):  # no JVM behind this session
        common.shared_dir(session)
    assert bool(made) == local
