"""The registered queries of the operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poledger.llm import (
    chat_format, decontaminate, exact_dedup, language_id, licenses, line_dedup, mixing, ngram_join, prefix_trie, quality, sharding, warc, whitening,
)
from poledger.plans.staging import place, settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    joined = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", joined.alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0
), bw AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS k FROM bs
), ds AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l
), dw AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS k FROM ds
), h AS (SELECT doc_id, item_id, s, l FROM dw JOIN bw USING (l, k)
), n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY 1
), i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{mixing.SEED}:' || doc_id) AS o
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][no % 3 + 1]::DOUBLE AS weight, source_size * 3 AS cap, sum(source_size) OVER ()::BIGINT AS total FROM s
), f AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) >= cap / weight AS full_up
  FROM w WINDOW b AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, CASE WHEN full_up THEN cap::DOUBLE
    ELSE (total - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ()) * weight / sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER () END AS target
  FROM f
), u AS (
  SELECT *, greatest(0, floor(target * (1 - 2.0 * count(*) OVER () / greatest(total, 1)))::BIGINT - 2) AS sure,
    least(cap, ceil(target * (1 + 2.0 * count(*) OVER () / greatest(sum(CASE WHEN target < cap THEN target ELSE 0 END) OVER (), 1)))::BIGINT + 2) AS most
  FROM t
), q AS (SELECT *, unnest(range(sure, most)) AS nth FROM u
), r AS (SELECT *, row_number() OVER (ORDER BY target / (2 * nth + 1) DESC, no, nth) AS rank FROM q
), won AS (
  SELECT no, any_value(sure) + count(nth) FILTER (rank <= total - (SELECT sum(sure) FROM u)) AS won FROM u LEFT JOIN r USING (no, sure, total) GROUP BY no
), p AS (
  SELECT doc_id, size, source_size, target, coalesce(won, 0) AS won,
    coalesce(sum(size) OVER (PARTITION BY t.no ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN won ON t.no = won.no
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (won // greatest(source_size, 1) * size + greatest(0, least(start + size, won % greatest(source_size, 1)) - start))::BIGINT AS taken
FROM p
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    index = warc.build_index(warc.scan(spark, path))
    return warc.resolved(warc.records(warc.captures_of(index)))


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), e AS (SELECT html, max(page_id) AS last FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last > page_id THEN last END AS refers_to
FROM p LEFT JOIN e USING (html)
"""


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"), licenses.known(spark))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(column: str) -> str:
    out = f"regexp_replace(replace(lower(coalesce({column}, '')), chr(13), chr(10)), {_sql_text(licenses.RIGHTS)}, chr(10), 'g')"
    out = f"trim(regexp_replace({out}, {_sql_text(licenses.MARKS)}, ' ', 'g'))"
    for written, compared in licenses.SPELLINGS:
        out = f"replace({out}, '{written}', '{compared}')"
    return f"sha256({out})"


OP7_SQL = f"""
WITH k AS (
  SELECT {_sql_canonical("t")} AS digest, min(id) AS license_id
  FROM (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in licenses.TEXTS)}) v(id, t) GROUP BY 1
), l AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
  FROM (SELECT doc_id, {_sql_canonical("line")} AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents))
  JOIN k USING (digest) GROUP BY doc_id
), d AS (SELECT doc_id, {_sql_canonical("text")} AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id, coalesce(n, 0) AS n_license_lines, coalesce(ids, '') AS line_licenses
FROM d LEFT JOIN k ON digest = canonical_sha256 LEFT JOIN l USING (doc_id)
"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", extra), (-7, 1, "assistant", extra)], "conv_id long, turn long, role string, text string"
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.turns_of(settle(chat_format.segments(rows), "segments"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_layout(_table(spark, sf_dir, "documents"), [1.0] * 16)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=4)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, k) AS pos, k, n FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n
    FROM conversations WHERE conv_id IS NOT NULL)
), i AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, turns, xor(4294967295, list_reduce([4294967295] || range(0, 8 * length(conv_id::VARCHAR)),
    lambda a, b: CASE WHEN (xor(a, CASE WHEN b % 8 = 0 THEN ord(substr(conv_id::VARCHAR, (b // 8)::INT + 1, 1)) ELSE 0 END) & 1) = 1
      THEN xor(xor(a, CASE WHEN b % 8 = 0 THEN ord(substr(conv_id::VARCHAR, (b // 8)::INT + 1, 1)) ELSE 0 END) >> 1, 3988292384)
      ELSE xor(a, CASE WHEN b % 8 = 0 THEN ord(substr(conv_id::VARCHAR, (b // 8)::INT + 1, 1)) ELSE 0 END) >> 1 END)) % 4 AS h
  FROM (SELECT conv_id, count(*) AS turns FROM r GROUP BY conv_id)
), j AS (SELECT i.*, least(i.h, coalesce(b.turns, 0)) AS taken FROM i LEFT JOIN i b ON b.conv_id = i.base
), t AS (
  SELECT j.conv_id, pos, k, n FROM j JOIN r ON r.conv_id = j.base AND pos <= h
  UNION ALL SELECT j.conv_id, pos - h + taken, k, n FROM j JOIN r ON r.conv_id = j.conv_id AND pos > h
), q AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS n FROM i
  UNION ALL SELECT conv_id, pos, array_to_string(list(k) OVER (PARTITION BY conv_id ORDER BY pos), ''), n FROM t
), node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS words FROM q GROUP BY path, depth
), kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, depth) AS path FROM q GROUP BY conv_id) GROUP BY path
), whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)
), sums AS (
  SELECT q.path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM whole v JOIN q ON q.conv_id = v.conv_id AND q.depth <= v.depth GROUP BY q.path
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM whole w JOIN sums USING (path) LEFT JOIN ends USING (path) LEFT JOIN node p ON w.depth > 0 AND p.path = left(w.path, length(w.path) - 64)
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.labelled(docs, language_id.fit(docs))


#: name -> (query, SQL or None where SQL cannot express it)
QUERIES = {
    "op1_exact_dedup": (op1_exact_dedup, OP1_SQL),
    "op2_decontaminate": (op2_decontaminate, OP2_SQL),
    "op3_quality": (op3_quality, None),
    "op4_mixing": (op4_mixing, OP4_SQL),
    "op5_line_dedup": (op5_line_dedup, None),
    "op6_warc": (op6_warc, OP6_SQL),
    "op7_licenses": (op7_licenses, OP7_SQL),
    "op8_chat_format": (op8_chat_format, None),
    "op9_ngram_join": (op9_ngram_join, None),
    "op10_sharding": (op10_sharding, None),
    "op11_whitening": (op11_whitening, None),
    "op12_prefix_trie": (op12_prefix_trie, OP12_SQL),
    "op13_language_id": (op13_language_id, None),
}
