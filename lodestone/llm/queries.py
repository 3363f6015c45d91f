"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import conversation_trie, exact_dedup, lexical_search, line_dedup, media_columns, ngram_join, packing, pii, sentencepiece_codec, sharding, substring_dedup, toxicity, warc_normaliser


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir), with_text=False)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.decisions(_documents(spark, sf_dir))
    return out.withColumn("text_sha256", F.lower(F.hex("text_sha256")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(_documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(_documents(spark, sf_dir)).drop("kept_text")


def op6_single_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later copy of a line, also among differing neighbours and in documents of 1 or 2 lines."""
    return line_dedup.remove_lines(_documents(spark, sf_dir), run=1).drop("kept_text")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_normaliser.warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest_column(_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_columns(_documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_of(_documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(_documents(spark, sf_dir))
    return lexical_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op6_single_line_dedup": op6_single_line_dedup,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_media": op10_media,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_sharding": op12_sharding,
    "op13_lexical_search": op13_lexical_search,
}

#: Remainders of the four-bit values by the CRC-32 polynomial.
_NIBBLES = [reduce(lambda x, _: (x >> 1) ^ (0xEDB88320 * (x & 1)), range(4), i) for i in range(16)]


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, four bits at a time."""
    halves = rf"string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\2\1', 'g'), '')"
    values = f"list_transform(list_filter({halves}, lambda x: x <> ''), lambda x: instr('0123456789ABCDEF', x)::BIGINT - 1)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda a, x: xor(a >> 4, ({_NIBBLES}::BIGINT[])[1 + (xor(a, x) & 15)])), 4294967295::BIGINT)"


ORACLE_SQL = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d),
        h AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM p),
        again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM h JOIN again USING (h)),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op2_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
    """,
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op6_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p
                   FROM documents WHERE text IS NOT NULL AND text <> ''),
        c AS (SELECT doc_id, p, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS j FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        w AS (SELECT doc_id, j, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS run FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
        r AS (SELECT doc_id, j, row_number() OVER (PARTITION BY run ORDER BY doc_id, j) AS k FROM w WHERE run IS NOT NULL),
        gone AS (SELECT DISTINCT doc_id, unnest(range(j, j + 3)) AS j FROM r WHERE k > 1),
        g AS (SELECT doc_id, p FROM c JOIN gone USING (doc_id, j)),
        t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS kept FROM l ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, coalesce((SELECT count(*) FROM c WHERE c.doc_id = d.doc_id), 0) AS n_lines,
               coalesce((SELECT count(*) FROM g WHERE g.doc_id = d.doc_id), 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN t USING (doc_id)
    """,
    "op7_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS lead FROM p),
        v AS (SELECT *, list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(1, 6), lambda j: instr('0123456789abcdef', substr(h, 5 * i + j, 1)) - 1), lambda a, b: a * 16 + b)) AS vs FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(vs, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest,
               CASE WHEN lead IS NULL OR lead = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN lead <> page_id THEN lead END AS refers_to
        FROM v
    """,
    "op6_single_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p
                   FROM documents WHERE text IS NOT NULL AND text <> ''),
        c AS (SELECT doc_id, p, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        n AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_removed FROM c GROUP BY doc_id),
        t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS kept FROM l ANTI JOIN (SELECT doc_id, p FROM c WHERE k > 1) USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op11_conversation_trie": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, turn, substr(sha256(length(role)::VARCHAR || ':' || role || text), 1, 32) AS k, length(text) AS chars FROM t),
        c AS (SELECT conv_id, list({{'k': k, 'chars': chars}} ORDER BY turn NULLS FIRST, k) AS ts FROM o GROUP BY conv_id),
        h AS (SELECT c.conv_id, c.ts, coalesce(b.ts, []) AS bs, {crc32_sql("c.conv_id::VARCHAR")} % 6 AS h FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
        r AS (SELECT conv_id, list_concat(bs[1:h], ts[h + 1:]) AS s FROM h),
        p AS (SELECT conv_id, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM r),
        q AS (SELECT conv_id, n, d, list_transform(s[1:d], lambda x: x.k) AS node, coalesce(s[d].chars, 0) AS chars FROM p),
        g AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM q GROUP BY node, d),
        w AS (SELECT g.*, NOT EXISTS (SELECT 1 FROM g x WHERE x.d = g.d + 1 AND x.node[1:g.d] = g.node) AS leaf FROM g),
        u AS (SELECT node[1:k] AS node, leaf, n_convs, chars FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM w)),
        s AS (SELECT node, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM u GROUP BY node),
        k AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL)
        SELECT g.conv_id, g.d AS depth, b.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
        FROM g JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN g b ON g.d > 0 AND b.d = g.d - 1 AND b.node = g.node[1:g.d - 1]
    """,
    "op12_sharding": f"""
        WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        k AS (SELECT DISTINCT h, ('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT AS key FROM d),
        w AS (SELECT h, key, 0::BIGINT AS j FROM k
              UNION ALL
              SELECT h, n, floor((j + 1) * (2147483648::DOUBLE / ((n >> 33) + 1)::DOUBLE))::BIGINT FROM (SELECT h, j, (key * {sharding.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS n FROM w WHERE j <= {sharding.SHARDS})),
        s AS (SELECT h, max(j) FILTER (j < {sharding.SHARDS}) AS shard, max(j) FILTER (j <= {sharding.SHARDS}) AS grown FROM w GROUP BY h)
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(h, 17, 8))::BIGINT % {sharding.BUCKETS}, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown::INT AS grown_shard
        FROM d JOIN s USING (h)
    """,
    "op13_lexical_search": r"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        c AS (SELECT count(*) FILTER (len(ws) > 0) AS n, sum(len(ws))::BIGINT AS l FROM t),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        w AS (SELECT row, doc_id, len(ws) AS n, unnest(ws) AS term FROM t),
        p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        g AS (SELECT term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM f, c),
        s AS (SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * c.n) // c.l))))::BIGINT AS score FROM q JOIN p USING (term) JOIN g USING (term), c GROUP BY ALL),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 50
    """,
}
