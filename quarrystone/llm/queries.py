"""The registered queries of this package and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, minhash, packing, quality, secret_scan, sharding, suffix_dedup, topk, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS t(conv_id, turn, role, text)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    template = chat.ChatTemplate()
    out = chat.format_chats(turns, template)
    out = out.withColumn("back", chat.read_back(F.col("formatted"), template))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescaped(s["text"])), "")
    return out.withColumn("_loss", loss).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_bad_turns",
        "valid",
    )


OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role, 1, 'start') OVER w AS before,
    replace(replace(replace(replace(replace(role, '~', '~0'), '[INST]', '~1INST]'), '[/INST]', '~1/INST]'), '<s>', '~2s>'), '</s>', '~2/s>') AS erole,
    replace(replace(replace(replace(replace(text, '~', '~0'), '[INST]', '~1INST]'), '[/INST]', '~1/INST]'), '<s>', '~2s>'), '</s>', '~2/s>') AS etext
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(erole) + length(etext) + length('[INST][/INST]</s>'))::BIGINT AS formatted_chars,
  sum(CASE WHEN (before || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') THEN 0 ELSE 1 END)::BIGINT AS n_bad_turns,
  n_bad_turns = 0 AS valid
FROM e GROUP BY conv_id
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    out = decontam.decontaminate(docs, items)
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p : p + 9], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM iw
), dw AS (
  SELECT rid, n, p, array_to_string(ws[p : p + n - 1], ' ') AS win
  FROM (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM d, lens WHERE len(ws) >= n)
), h AS (SELECT rid, n, p, item_id FROM dw JOIN iw USING (n, win)
), hit AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, n, p FROM h)) GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid)
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, urlfilter.RULES).select("page_id", "host", "path", "rule", "verdict")


#: One regular expression for all of the method's own patterns.
METHOD = "|".join([rf"(?:^|[./_-])(?:{urlfilter.WORDS.replace(' ', '|')})(?:[./_-]|$)", rf"/(?:{urlfilter.PIECES.replace(' ', '|')})/", "/feed/rss(?:/|$)"])
OP4_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), f AS (
  SELECT *, '.' || host AS dotted, host || path AS whole,
    ends_with('.' || host, '.example.com') AND starts_with(path, '/en/7') AS r1,
    ends_with('.' || host, '.example.net') AND starts_with(path, '/de/8') AS r2,
    ends_with('.' || host, '.com') AND starts_with(path, '/en/') AS r3,
    ends_with('.' || host, '.net') AND starts_with(path, '/de/') AS r4,
    ends_with('.' || host, '.org') AND starts_with(path, '/es/') AS r5
  FROM p
)
SELECT page_id, host, path,
  CASE WHEN r1 THEN 'example.com/en/7' WHEN r2 THEN 'example.net/de/8' WHEN r3 THEN 'com/en/' WHEN r4 THEN 'net/de/' WHEN r5 THEN 'org/es/' END AS rule,
  CASE WHEN r1 THEN 'allow' WHEN r2 THEN 'block' WHEN r3 THEN 'block' WHEN r4 THEN 'allow' WHEN r5 THEN 'block'
       WHEN regexp_matches(whole, 'METHOD') THEN 'block'
       ELSE 'allow' END AS verdict
FROM f
""".replace("METHOD", METHOD)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleaved_shards(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each finding, false ones (is_secret false) included."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = tuple(secret_scan.corpus_words(docs))
    return secret_scan.scan(docs, words=words).select("doc_id", F.inline("findings"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT a.uid, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.uid <> b.uid AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_quality(docs, quality.fit_quality(docs, labels))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with its class of near copies."""
    out = minhash.near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "class_docs", "copies")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_shards": op5_shards,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_top_k": op8_top_k,
    "op9_quality": op9_quality,
    "op10_near_dedup": op10_near_dedup,
}
ORACLE_SQL = {"op2_chat_format": OP2_SQL, "op3_decontaminate": OP3_SQL, "op4_url_filter": OP4_SQL, "op8_top_k": OP8_SQL}
