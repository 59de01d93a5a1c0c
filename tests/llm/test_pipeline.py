"""The corpus pipeline's stages on the small table."""

import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from pcframe.llm import compression_bands, super_minhash
from tests.llm.test_operators import brute_components, brute_lines, brute_quality, reference_ids, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, written and read again as the driver does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, SF).write.parquet(path)
        given, docs = docs, spark.read.parquet(path)
        out.append((given, docs))
    return out


def test_columns(stages):
    for given, gave in stages[:-1]:
        assert gave.columns == given.columns and gave.count() > 0


def test_quality_and_near_dedup(stages):
    given, gave = stages[0]
    want = {r.doc_id for r in compression_bands.quality(given).where("kept").collect()}
    assert {r.doc_id for r in gave.collect()} == want and len(want) < given.count()
    given, gave = stages[2]
    want = {r.doc_id for r in super_minhash.near_duplicates(given).where("kept").collect()}
    assert {r.doc_id for r in gave.collect()} == want


def test_lines(stages):
    given, gave = stages[1]
    lines = gave.select(F.explode(F.split("text", "\n")).alias("x")).where("trim(x) <> ''")
    assert lines.count() == lines.distinct().count()
    own = given.select(F.explode(F.split("text", "\n")).alias("x")).distinct()
    assert lines.join(own, "x", "left_anti").count() == 0
    assert gave.where("n_chars <> length(text) or text = ''").count() == 0


def test_mixing_and_packing(stages):
    given, gave = stages[3]
    n = gave.groupBy("doc_id").count()
    assert n.count() == given.count() and n.agg(F.max("count")).first()[0] <= corpus_pipeline.MAX_REPEATS
    given, gave = stages[4]
    copies = {r.doc_id: r["count"] for r in given.groupBy("doc_id").count().collect()}
    got = {r.doc_id: r.n for r in gave.groupBy("doc_id").agg((F.sum("length") / F.max("doc_tokens")).alias("n")).collect()}
    assert got == copies


def test_stages_equal_brute_force(spark, stages):
    """All stages told again in plain Python, from the generated documents to the pieces."""
    rows = {r.doc_id: r for r in stages[0][0].collect()}
    z, left = zstandard.ZstdCompressor(level=3), []
    for i, r in sorted(rows.items()):
        n, _, _, _, again = brute_quality(r.text)
        if n < 10 or 100 * again > 20 * n:
            continue
        data = (r.text or "").encode()
        limits = [(low, high) for least, low, high in compression_bands.Bands().whole if least <= len(data)][-1]
        chunks = [4096 / len(z.compress(data[at : at + 4096])) for at in range(0, len(data) - 4095, 4096)]
        odd = sum(not 1.4 <= c <= 3.0 for c in chunks)
        if limits[0] <= len(data) / len(z.compress(data)) <= limits[1] and (not chunks or odd / len(chunks) <= 0.3):
            left.append((i, r.text))
    assert {r.doc_id for r in stages[0][1].collect()} == {i for i, _ in left}
    left = [(i, kept) for i, _, kept, _ in brute_lines(left) if kept.strip("\x20\t\n\r\x0b\f")]
    assert {r.doc_id: r.text for r in stages[1][1].collect()} == dict(left)
    found = brute_components(left, 5)
    left = [(i, t) for i, t in left if (False, i, i) in {(x, y, c) for x, y, _, c in found}]
    assert {r.doc_id: r.text for r in stages[2][1].collect()} == dict(left)
    tokens, mixed = Counter(), Counter()
    for i, t in left:
        tokens[rows[i].source] += max(1, len(t.encode().split()))
    copies = Counter(r.doc_id for r in stages[3][1].collect())
    for i, t in left:
        mixed[rows[i].source] += copies[i] * max(1, len(t.encode().split()))
    assert set(copies) == {i for i, _ in left} and set(copies.values()) <= {1, 2}
    low, top = min(tokens.values()), max(tokens.values())
    assert min(mixed[s] / tokens[s] for s in tokens) >= 1 and (top / low <= 2 or max(mixed[s] / tokens[s] for s in tokens) > 1.5)
    texts, got = dict(left), {}
    for r in stages[4][1].collect():
        got.setdefault((r.doc_id, r.start, r.length), []).append(r.ids_crc32)
    by_doc: dict = {}
    for (i, start, length), crcs in got.items():
        by_doc.setdefault(i, []).append((start, length, crcs))
    for i, pieces in by_doc.items():
        ids = np.asarray([*reference_ids(texts[i]), 1], "<u4")
        assert all(set(crcs) == {zlib.crc32(ids[start : start + length].tobytes())} for start, length, crcs in pieces)
        assert sum(length * len(crcs) for _, length, crcs in pieces) == copies[i] * len(ids)
    assert set(by_doc) == set(texts)


def test_run_equals_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first() == stages[-1][1].agg(F.sum("length")).first()


ROWS = [
    (1, "a fresh text of ten words or more, told in one line only", "en", "a"), (1, "a fresh text of ten words or more, told in one line only", "en", "a"),
    (2, None, "en", "a"), (3, "", None, None), (4, " \n\t", "en", "b"), (5, "short", "en", None),
    (None, "a text without any id of ten words and of some more", "en", "a"), (6, "first line that stands here alone today\nsecond line that comes again in another\nlast", "en", "b"),
    (7, "second line that comes again in another\nand a line of its own with many more words in it", None, None), (8, "a fresh text of ten words or more, told in one line only\n", "en", "c"),
    (9, "word" + " other" * 40, "en", "a"), (10, text(8, 5_000).replace("\n", ""), "en", "c"), (11, text(8, 5_000).replace("\n", "") + " more", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the stages' own."""
    names = ["__gone", "__quality", "__row", "__id", "__text", "kept", "line", "block", "epoch", "batch_id"]
    d = spark.createDataFrame([(i, t, lang, s, 0 if t is None else len(t)) for i, t, lang, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({n: F.lit(n) for n in names}).repartition(3).cache()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_each_stage_on_odd_rows(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, odd, SF).collect()
    assert stage(spark, odd.limit(0), SF).count() == 0
    if k < len(corpus_pipeline.STAGES) - 1:
        assert all(r["__gone"] == "__gone" and r.kept == "kept" and r.line == "line" for r in got)
        assert stage(spark, odd, SF).columns == odd.columns
    left = sorted((-1 if r.doc_id is None else r.doc_id) for r in got)
    if name == "quality rules":
        assert left == [-1, 1, 1, 6, 7, 8, 10, 11]  # two words told forty times over, and fewer than ten words, go
    elif name == "line dedup":
        assert left == [-1, 1, 1, 5, 6, 7, 9, 10] + [11]  # 8 is 1 again; rows of one id and text are one document
        assert {r.text for r in got if r.doc_id == 7} == {"and a line of its own with many more words in it"} and all(r.n_chars == len(r.text) for r in got)
    elif name == "MinHash near-dedup":
        assert left == [-1, 1, 1, 2, 3, 4, 5, 6, 7, 9, 10]
    elif name == "mixing sources to target weights":
        assert set(left) == {-1 if i is None else i for i, *_ in ROWS} and len(left) >= len(ROWS)
    else:
        whole = sum(r.length for r in got)
        assert whole == sum(r.doc_tokens for r in got if r.start == 0) and set(left) == {-1 if i is None else i for i, *_ in ROWS}
