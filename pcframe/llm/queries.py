"""The registered queries of the text operators, over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pcframe.llm import capture_index, compression_bands, countmin_substrings, scaled_sketch, segment_lines, separator_scan, sum_of_squares, super_minhash, temperature_mixing, zstd_classifier
from pcframe.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.fingerprints(table(spark, sf_dir, "documents"))


def op2_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index.round_trip(table(spark, sf_dir, "pages")).drop("html")


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mixing.mix(table(spark, sf_dir, "documents"))


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_of_squares.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_countmin_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = countmin_substrings.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.token_counts(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "n_tokens")


def op7_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.quality(table(spark, sf_dir, "documents"))


def op9_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment_lines.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_zstd_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = zstd_classifier.fit(docs, labels, train=~held_out)
    return zstd_classifier.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_scaled_sketch, op2_capture_index, op3_temperature_mixing, op4_sum_of_squares_packing, op5_countmin_substrings,
        op6_separator_scan, op7_super_minhash, op8_compression_bands, op9_segment_lines, op10_zstd_classifier,
    )
}
ORACLE: dict[str, str] = {
    "op2_capture_index": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM f""",
    "op5_countmin_substrings": """
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
        g AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p),
        f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY 1),
        c AS (SELECT DISTINCT doc_id, i + j AS pos FROM g JOIN f USING (g), range(13) t(j) WHERE doc_id > least),
        k AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op7_super_minhash": """
        WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS to_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.to_id = e.a),
        c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op9_segment_lines": """
        WITH d AS MATERIALIZED (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
        p AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
        x AS MATERIALIZED (SELECT * FROM (SELECT doc_id, i, trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM p) WHERE line <> ''),
        u AS MATERIALIZED (SELECT line, min(doc_id * 4294967296 + i) AS place, length(line) AS n FROM x GROUP BY 1),
        t AS (SELECT a.line AS a, b.line AS b FROM u a JOIN u b ON left(a.line, 9) = left(b.line, 9) AND a.place > b.place WHERE a.n >= 20 AND b.n >= 20 AND abs(a.n - b.n) <= 1
              UNION SELECT a.line, b.line FROM u a JOIN u b ON right(a.line, 9) = right(b.line, 9) AND a.place > b.place WHERE a.n >= 20 AND b.n >= 20 AND abs(a.n - b.n) <= 1),
        z AS (SELECT DISTINCT a AS line, true AS near FROM t WHERE len(list_filter(range(0, length(a) + 1), lambda k: left(a, k) = left(b, k) AND substr(a, k + CASE WHEN length(a) < length(b) THEN 1 ELSE 2 END) = substr(b, k + CASE WHEN length(b) < length(a) THEN 1 ELSE 2 END))) > 0),
        k AS (SELECT doc_id, list(i) AS gone FROM x JOIN u USING (line) LEFT JOIN z USING (line) WHERE near OR doc_id * 4294967296 + i > place GROUP BY 1)
        SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(list_filter(l, lambda x, i: NOT list_contains(coalesce(gone, []), i)), chr(10))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
}
