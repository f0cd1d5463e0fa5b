"""The thin contract queries: each applies its operator to the whole given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm import block_simhash, chat_format, conversation_repair, cover_tree, deleted_interpolation, extendible_sharding
from pairloom.llm import lsa_neighbours, piece_codec, rank_order, simhash_vptree, spaced_seeds, suffix_dedup, vector_packing
from pairloom.llm.common import distinct_documents, fold, outer_id

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.strip_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


@query("op2_simhash_vptree")
def op2_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_vptree.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


@query("op8_rank_order")
def op8_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    profiles = rank_order.learn_profiles(docs.where(F.coalesce(rest != 0, F.lit(True))))
    found = rank_order.identify(distinct_documents(docs), profiles)
    return found.select(outer_id(), F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op3_spaced_seeds")
def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_vector_packing")
def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return vector_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op1_extendible_sharding",
    f"""
    WITH d AS (
        SELECT doc_id, coalesce(strlen(text), 0) AS bytes, ('0x' || substr(md5(coalesce('v' || doc_id, 'n')), 1, 15))::BIGINT AS h FROM documents),
    n AS (
        SELECT depth, h >> (60 - depth) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
        FROM d, (SELECT unnest(range(0, 61))::INT AS depth) GROUP BY ALL),
    leaf AS (
        SELECT doc_id, bytes, min(depth) AS depth, arg_min(prefix, depth) AS prefix, arg_min(n.shard_rows, depth) AS shard_rows, arg_min(n.shard_bytes, depth) AS shard_bytes
        FROM d JOIN n ON n.prefix = d.h >> (60 - n.depth) WHERE n.shard_bytes <= {extendible_sharding.LIMIT} GROUP BY doc_id, bytes)
    SELECT doc_id, bytes, depth::BIGINT AS depth, prefix, 0::BIGINT AS page, shard_rows, shard_bytes, (max(depth) OVER ())::BIGINT AS global_depth FROM leaf
    """,
)
def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distinct_documents(table(spark, sf_dir, "documents")).select(outer_id(), F.octet_length("text").alias("bytes"))
    out = extendible_sharding.assign(rows, "doc_id", "bytes")
    return out.withColumnsRenamed({"key": "doc_id", "size": "bytes"})


MARKED = "regexp_replace({}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"


@query(
    "op5_chat_format",
    f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{chat_format.PROBE}'), (-1, 1, 'assistant', '{chat_format.PROBE}'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
        coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
        sum({len("".join(chat_format.MARKS))} + length({MARKED.format("r")}) + length({MARKED.format("x")}))::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id
    """,
)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", chat_format.PROBE), (-1, 1, "assistant", chat_format.PROBE)], turns.schema)
    return chat_format.report(turns.unionByName(probe), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_block_simhash")
def op7_block_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_simhash.edit_report(table(spark, sf_dir, "documents"))


@query("op9_lsa_neighbours")
def op9_lsa_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = distinct_documents(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long"), F.col("quality").alias("label"))
    found = lsa_neighbours.score(docs, labels.where(F.coalesce(fold(4) != 2, F.lit(False))))
    held_out = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    return found.select(outer_id(), held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op6_deleted_interpolation")
def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = distinct_documents(table(spark, sf_dir, "documents")).withColumn("fold", F.coalesce(fold(7), F.lit(0)).cast("long"))
    out = deleted_interpolation.score(docs)
    held_out = F.coalesce(fold(7) == 2, F.lit(False)).alias("held_out")
    return out.select(outer_id(), held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op11_stream_repair",
    r"""
    WITH RECURSIVE k AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(key)), lambda i: ascii(key[i + 1])::BIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc
        FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
    d AS (
        SELECT conv_id, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role,
            CASE part WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN part = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM (SELECT *, xor(crc, 4294967295) % 20 AS part FROM k) WHERE part <> 0),
    u AS (SELECT *, row_number() OVER () AS id FROM d),
    o AS (
        SELECT *, sha256(length(role) || ':' || role || text) AS sha, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
            NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM u),
    f AS (
        SELECT *, row_number() OVER t AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS c, lead(left(role, 1)) OVER t AS after,
            NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id) > 1 AS again
        FROM o WINDOW t AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha, id)),
    g AS (SELECT *, cut AND NOT blank AND NOT again AS short FROM f),
    -- from the last turn back: the cheapest way on from each place of the pattern, as (cost, edits, turns)
    walk AS (
        SELECT conv_id, max(n) + 1 AS i, {'c': 0, 'a': '', 'r': ''} AS p0, {'c': 10, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)} AS p1,
            {'c': 5, 'a': 'I', 'r': 'assistant:' || chr(10)} AS p2, {'c': 0, 'a': '', 'r': ''} AS p3
        FROM g GROUP BY conv_id
        UNION ALL
        SELECT conv_id, i,
            least(w0, {'c': w2.c + 5, 'a': 'I' || w2.a, 'r': 'user:' || chr(10) || w2.r}, {'c': w3.c + 10, 'a': 'II' || w3.a, 'r': 'user:' || chr(10) || 'assistant:' || chr(10) || w3.r}),
            least(w1, {'c': w2.c + 5, 'a': 'I' || w2.a, 'r': 'user:' || chr(10) || w2.r}, {'c': w3.c + 10, 'a': 'II' || w3.a, 'r': 'user:' || chr(10) || 'assistant:' || chr(10) || w3.r}),
            least(w2, {'c': w3.c + 5, 'a': 'I' || w3.a, 'r': 'assistant:' || chr(10) || w3.r}),
            least(w3, {'c': w2.c + 5, 'a': 'I' || w2.a, 'r': 'user:' || chr(10) || w2.r})
        FROM (
            SELECT conv_id, i,
                least({'c': p0.c + 2, 'a': 'D' || p0.a, 'r': p0.r}, {'c': p2.c + kr + 1, 'a': 'R' || p2.a, 'r': 'user:' || line || p2.r},
                    {'c': CASE c WHEN 's' THEN p1.c WHEN 'u' THEN p2.c ELSE 1000000000 END + kr, 'a': 'K' || CASE c WHEN 's' THEN p1.a ELSE p2.a END, 'r': role || ':' || line || CASE c WHEN 's' THEN p1.r ELSE p2.r END}) AS w0,
                least({'c': p1.c + 2, 'a': 'D' || p1.a, 'r': p1.r}, {'c': p2.c + kr + 1, 'a': 'R' || p2.a, 'r': 'user:' || line || p2.r},
                    {'c': CASE c WHEN 'u' THEN p2.c ELSE 1000000000 END + kr, 'a': 'K' || p2.a, 'r': role || ':' || line || p2.r}) AS w1,
                least({'c': p2.c + 2, 'a': 'D' || p2.a, 'r': p2.r}, {'c': p3.c + kr + 1, 'a': 'R' || p3.a, 'r': 'assistant:' || line || p3.r},
                    {'c': CASE c WHEN 'a' THEN p3.c ELSE 1000000000 END + kr, 'a': 'K' || p3.a, 'r': role || ':' || line || p3.r}) AS w2,
                least({'c': p3.c + 2, 'a': 'D' || p3.a, 'r': p3.r}, {'c': p2.c + kr + 1, 'a': 'R' || p2.a, 'r': 'user:' || line || p2.r},
                    {'c': CASE c WHEN 'u' THEN p2.c ELSE 1000000000 END + kr, 'a': 'K' || p2.a, 'r': role || ':' || line || p2.r}) AS w3
            FROM (
                SELECT walk.*EXCLUDE i, g.i, g.c, g.role, g.text || chr(10) AS line, CASE WHEN blank OR again THEN 1000000 WHEN short THEN 5 ELSE 0 END AS kr
                FROM walk JOIN g ON g.conv_id IS NOT DISTINCT FROM walk.conv_id AND g.i = walk.i - 1))),
    s AS (
        SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
            count(*) FILTER (short) AS truncated, count(*) FILTER (after IS NOT NULL AND c || after NOT IN ('su', 'ua', 'au')) AS illegal
        FROM g GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
        coalesce(s.illegal, 0) AS illegal, coalesce(p0.c, 0)::BIGINT AS cost, coalesce(p0.a, '') AS audit, sha256(coalesce(p0.r[:-2], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM c.conv_id AND walk.i = 1
    """,
)
def op11_stream_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


@query("op12_backtracking_pieces")
def op12_backtracking_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = piece_codec.report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("doc_id", outer_id())


@query(
    "op13_cover_tree",
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT anchor_id, p.other AS positive_id, (row_number() OVER w)::INT AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n USING (anchor_id) WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    WINDOW w AS (PARTITION BY anchor_id, p.other ORDER BY n.score DESC, n.other) QUALIFY row_number() OVER w <= 3
    """,
)
def op13_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cover_tree.whole(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return cover_tree.mine(rows, rows.where("vec_id % 50 = 0"))
