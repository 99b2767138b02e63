"""The subpackage's registered queries: each applies its operator to the whole given table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.llm import chat, cover_tree, decontaminate, fingerprints, jaccard, language, packing, ppm, prefix_trie, quality, resample, token_counts, token_files
from embertrace.llm.common import fold, new_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of all documents."""
    return jaccard.classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of all documents; the model learns outside fold 0 of 5."""
    docs = documents(spark, sf_dir)
    model = language.fit(docs, fold("doc_id", 5) != 0)
    held = (fold("doc_id", 5) == 0).alias("held_out")
    return language.predict(docs.select("doc_id", held, "text"), model).drop("text")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and byte counts of all documents through a new digest cache in the shared folder."""
    cache = token_counts.DigestCache(spark)
    return token_counts.with_limit(token_counts.count_tokens(documents(spark, sf_dir), "byte_bpe_50k.json", cache))


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as directly addressable token files, and what reading them back gives."""
    path = new_folder(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path, "word_bpe_49k.json")
    return token_files.read_token_files(spark, path)


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    return fingerprints.fingerprints(documents(spark, sf_dir))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality scores of all documents; the model learns labels outside fold 0 of 5."""
    docs = documents(spark, sf_dir)
    stats = written(quality.with_statistics(docs.withColumn("held_out", fold("doc_id", 5) == 0), ["doc_id", "held_out"]), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.labelled_statistics(stats, labels, ~F.col("held_out")))
    return quality.scored(stats, model).withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat.render(turns).withColumn("n_chars", F.length("rendered").cast("bigint"))


@query
def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and byte-trie scores of all documents; both models learn outside fold 0 of 10."""
    docs = documents(spark, sf_dir)
    rows = ppm.scores(docs, fold("doc_id", 10) != 0)
    held = (fold("doc_id", 10) == 0).alias("held_out")
    return rows.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), "byte_bpe_50k.json")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item and where it stands."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaks(documents(spark, sf_dir), benchmark).drop("version")


@query
def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and the class of all embeddings."""
    return cover_tree.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of all documents towards the benchmark's words, and the drawn ones ranked."""
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# CRC-32 of the bytes of text {}: the usual table, one row of it for each byte value.
CRC_TABLE = """(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS row
  FROM range(256) t(i))"""
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(hex(encode({0}))), 2), lambda k: ('0x' || substr(hex(encode({0})), k::INT + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, row[xor(c % 256, b) + 1])), 4294967295)"""

ORACLES["op11_cover_tree"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS vec_id, coalesce(any_value(n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = r.a GROUP BY r.a"""

ORACLES["op12_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {CRC.format("conv_id::VARCHAR")} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM t), {CRC_TABLE}),
m AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(len(role) || ':' || role || len(text) || ':' || text, '') OVER w AS prefix, strlen(text) AS bytes
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved FROM p GROUP BY depth, prefix),
u AS (
  SELECT DISTINCT x.depth AS up_depth, x.prefix AS up_prefix, y.depth, y.prefix
  FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.depth <= y.depth),
k AS (SELECT up_depth AS depth, up_prefix AS prefix, count(*) AS n_children FROM u WHERE depth = up_depth + 1 GROUP BY ALL),
s AS (
  SELECT up_depth AS depth, up_prefix AS prefix, sum((k.n_children IS NULL)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM u JOIN n USING (depth, prefix) LEFT JOIN k USING (depth, prefix) GROUP BY ALL),
e AS (SELECT depth, prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends
  FROM (SELECT * FROM p QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY ALL)
SELECT n.conv_id, n.depth, v.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256,
  (SELECT count(*) FROM u WHERE up_depth = n.depth AND up_prefix = n.prefix) AS n_nodes
FROM n JOIN s USING (depth, prefix) LEFT JOIN k USING (depth, prefix) LEFT JOIN e USING (depth, prefix)
LEFT JOIN u ON u.depth = n.depth AND u.prefix = n.prefix AND u.up_depth = n.depth - 1
LEFT JOIN n v ON v.depth = u.up_depth AND v.prefix = u.up_prefix"""

ORACLES["op13_resampling"] = r"""
WITH w AS (
  SELECT doc_id, true AS source, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT NULL, false, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT source, doc_id, unnest(w) AS word FROM w),
k AS (SELECT word, CRC_OF_WORD % 10000 AS bucket FROM (SELECT DISTINCT word FROM f), CRC_TABLE),
n AS (SELECT bucket, count(*) FILTER (source)::DOUBLE AS s, count(*) FILTER (NOT source)::DOUBLE AS t FROM f JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))))::BIGINT AS gain FROM n),
d AS (
  SELECT doc_id, count(word) AS n_features, coalesce(floor(sum(gain) / count(word)), 0)::BIGINT AS weight
  FROM documents LEFT JOIN (SELECT doc_id, word, gain FROM f JOIN k USING (word) JOIN g USING (bucket) WHERE source) USING (doc_id) GROUP BY doc_id),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 10 // 100 AS drawn FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
""".replace("CRC_OF_WORD", CRC.format("word")).replace("CRC_TABLE", CRC_TABLE)

ORACLES["op7_chat"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg('<|im_start|>' || replace(replace(coalesce(role, 'user'), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')
      || chr(10) || replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')
      || '<|im_end|>' || chr(10), '') OVER w AS rendered
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS copies, rendered FROM p WHERE pos = n GROUP BY n, rendered)
SELECT conv_id, n_turns, copies, rendered, length(rendered) AS n_chars FROM f
WHERE rendered NOT IN (SELECT rendered FROM p WHERE pos < n)"""

ORACLES["op10_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents)),
i AS (
  SELECT item_id, len(w) AS item_words, unnest(w) AS word, generate_subscripts(w, 1) AS at
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM benchmark)),
a AS (
  SELECT doc_id, item_id, item_words, d.at - i.at AS start, count(*) AS agreeing
  FROM d JOIN i USING (word) GROUP BY ALL HAVING count(*) >= 0.6 * item_words)
SELECT doc_id, item_id, agreeing, item_words, agreeing / item_words AS share, start
FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agreeing DESC, start) = 1"""

ORACLES["op1_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, coalesce(any_value(l.n_links), 0) AS n_links
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a) l USING (doc_id) GROUP BY doc_id"""
