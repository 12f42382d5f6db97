"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remove_folder, shared_folder, table
from .decontaminate import leaks
from .jaccard_join import jaccard_components
from .license_scan import license_digest, scan_licenses
from .lm_scoring import stupid_backoff
from .packing import pack
from .phrases import fingerprint_documents
from .prefix_trie import prefix_trie
from .quality_kn import classify_quality
from .simhash_dedup import near_duplicates
from .spelling import spelling_variants
from .token_counts import prefix_token_counts
from .toxicity import score_toxicity
from .warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return prefix_token_counts(table(spark, sf_dir, "documents"), model, keep_prefixes=False)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = cut(archive_pages(table(spark, sf_dir, "pages"), folder))
    remove_folder(spark, folder)
    return rows


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = stupid_backoff(table(spark, sf_dir, "documents"))
    # sums of floating-point numbers depend on their order in the last digits
    return scores.withColumns({"log_score": F.round("log_score", 3) + 0.0, "score": F.round("score", 6) + 0.0})


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_dedup,
        op2_token_counts,
        op3_packing,
        op4_license_scan,
        op5_arc_to_warc,
        op6_document_fingerprints,
        op7_benchmark_decontamination,
        op8_quality_classifier,
        op9_lm_scoring,
        op10_toxicity,
        op11_prefix_trie,
        op12_jaccard_join,
        op13_spelling_variants,
    )
}

_WORDS = "string_split_regex(lower(trim(coalesce(text, ''), ' \t\n\x0b\f\r')), '[ \\t-\\r]+')"
_SPLIT = "string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+')"
_BIT = "CAST(substr(bits, CAST(5 * i + {n} AS INT), 1) AS INT)"


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit."""
    code = f"hex(encode({text}))"
    byte = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr({code}, CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295], {byte}), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: {bit})), 4294967295)"


#: SQL that DuckDB runs for the same rows; the other operators are beyond SQL and tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_arc_to_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
    lpad(bin(instr('0123456789abcdef', substr(hex, CAST(i AS INT), 1)) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + """
    + " + ".join(f"{16 >> (n - 1)} * {_BIT.format(n=n)}" for n in range(1, 6))
    + """, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM b""",
    "op7_benchmark_decontamination": f"""
WITH i AS (SELECT DISTINCT item_id, w, len(w) AS m, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE w[1] <> ''),
items AS (SELECT *, list_transform(range(1, m - k + 2), lambda x: array_to_string(w[x : x + k - 1], ' ')) AS shingles FROM i),
places AS (SELECT DISTINCT m, k, unnest(shingles) AS shingle FROM items),
docs AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE w[1] <> ''),
spots AS (SELECT doc_id, n, k, unnest(range(0, n - k + 1)) AS at FROM docs, (SELECT DISTINCT k FROM items)),
read AS (SELECT s.doc_id, s.n, s.k, s.at, array_to_string(d.w[s.at + 1 : s.at + s.k], ' ') AS shingle FROM spots s JOIN docs d USING (doc_id)),
starts AS (SELECT DISTINCT r.doc_id, p.m, p.k, greatest(0, least(r.at, r.n - p.m)) AS start FROM read r JOIN places p ON r.shingle = p.shingle AND r.k = p.k),
met AS (SELECT s.*, i.item_id, i.shingles FROM starts s JOIN items i ON s.m = i.m),
windows AS (SELECT met.*, list_transform(range(start + 1, least(start + m, d.n) - k + 2), lambda x: array_to_string(d.w[x : x + k - 1], ' ')) AS own FROM met JOIN docs d USING (doc_id)),
alike AS (SELECT doc_id, item_id, start, len(shingles) + len(own) AS sizes, list_sum(list_transform(list_distinct(shingles), lambda s:
    least(len(list_filter(shingles, lambda y: y = s)), len(list_filter(own, lambda y: y = s))))) AS common FROM windows)
SELECT doc_id, item_id, max(common / (sizes - common)) AS similarity, CAST(min(start) AS INT) AS first_word FROM alike
WHERE common / (sizes - common) >= 0.8 GROUP BY doc_id, item_id""",
    "op9_lm_scoring": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT *, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY r, c) AS k1, count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY r, b, c) AS k2,
    count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY r, a, b, c) AS k3, count(*) OVER () - count(*) OVER (PARTITION BY r) AS others FROM t),
p AS (SELECT *, lag(k1) OVER (PARTITION BY r ORDER BY i) AS p1, lag(k2) OVER (PARTITION BY r ORDER BY i) AS p2 FROM k),
s AS (SELECT r, CASE WHEN i > 2 AND k3 > 0 THEN ln(k3 / p2) WHEN i > 1 AND k2 > 0 THEN (least(i, 3) - 2) * ln(0.4) + ln(k2 / p1)
    ELSE (least(i, 3) - 1) * ln(0.4) + CASE WHEN k1 > 0 THEN ln(k1 / others) ELSE -ln(others + 1) END END AS s FROM p)
SELECT d.doc_id, count(s.r) AS n_tokens, round(coalesce(sum(s.s), 0), 3) + 0.0 AS log_score, round(avg(s.s), 6) + 0.0 AS score FROM d LEFT JOIN s ON s.r = d.r GROUP BY d.r, d.doc_id""",
    "op11_prefix_trie": f"""
WITH c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM c),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS turn FROM conversations),
r AS (SELECT h.conv_id, 0 AS part, pos, turn FROM h JOIN t ON t.conv_id = base AND pos <= h UNION ALL SELECT h.conv_id, 1, pos, turn FROM h JOIN t ON t.conv_id = h.conv_id AND pos > h),
f AS (SELECT c.conv_id, coalesce(s.seq, []) AS seq FROM c LEFT JOIN (SELECT conv_id, list(turn ORDER BY part, pos) AS seq FROM r GROUP BY conv_id) s ON s.conv_id = c.conv_id),
m AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM f),
n AS (SELECT depth, seq[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = depth) AS ends FROM m GROUP BY ALL),
k AS (SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * strlen(n.node[n.depth].text) ELSE 0 END AS saved FROM n LEFT JOIN k ON k.depth = n.depth AND k.node = n.node),
s AS (SELECT d AS depth, node[1:d] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM v) GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s ON s.depth = v.depth AND s.node = v.node LEFT JOIN v p ON p.depth = v.depth - 1 AND p.node = v.node[1:v.depth - 1]""",
    "op12_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter({_SPLIT}, lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) < 5 THEN CASE WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS own FROM d),
e AS (SELECT r, len(own) AS n, unnest(own) AS shingle FROM s),
links AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY a.r, b.r HAVING 180 * count(*) >= 80 * (any_value(a.n) + any_value(b.n))),
least(r, c) USING KEY (r) AS (SELECT r, doc_id FROM s UNION SELECT l.b, min(x.c) FROM least x JOIN links l ON l.a = x.r JOIN recurring.least y ON y.r = l.b WHERE x.c < y.c GROUP BY l.b)
SELECT s.doc_id, CAST(len(own) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN least USING (r)""",
    "op13_spelling_variants": f"""
WITH RECURSIVE o AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, n, {_crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM o),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.less = y.less AND x.i = y.i AND x.word <> y.word UNION
    SELECT d.word, w.word FROM d JOIN w ON d.less = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.less = w.word),
k AS (SELECT a, b, w.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, encode(b)) AS nth FROM p JOIN w ON w.word = b),
f AS (SELECT w.word, w.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.n >= 10 * w.n THEN k.b END AS form, CASE WHEN k.n >= 10 * w.n THEN k.n END AS form_n FROM w LEFT JOIN k ON k.a = w.word AND nth = 1),
r AS (SELECT word, word AS root FROM f UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.root WHERE e.form IS NULL""",
}
