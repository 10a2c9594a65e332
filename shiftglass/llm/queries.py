"""The ``opN_<name>`` queries: each operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import convtrie, hpylm, langid, linedup, mixing, mixpack, packing, phrases, probminhash, progjpeg, substring, topk, warc
from .common import Scratch, table, tokenizer_path


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from those not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.remainder("doc_id", 4) == 2)
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op1_hpylm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HPYLM log10 probability of every document, learnt from those not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("learn", langid.remainder("doc_id", 5) != 1)
    model = hpylm.Model(docs)
    model.sample()
    scored = Scratch(spark, "hpylm-scores").keep(model.score())
    model.close()
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector against all others."""
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, F.col("id") % 50 == 0, 5)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document because a window of 35 words occurs elsewhere."""
    found = substring.dedup(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and whether it stands for it."""
    found = probminhash.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("rep").alias("kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines deleted from every document as later copies of repeated runs."""
    found = linedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_copy", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a progressive JPEG in a stored table, and what is read back from it."""
    stored = Scratch(spark, "media").keep(progjpeg.write_media(table(spark, sf_dir, "documents")))
    found = progjpeg.read_media(stored, tensors=False)
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document for the target mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    sized = Scratch(spark, "mix").keep(docs)
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    found = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(found)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives, by way of the merged index."""
    index = warc.capture_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position")


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in mixed sequences of 2048 tokens."""
    return mixpack.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best-scoring phrases of two or three words of every language."""
    return phrases.mine(table(spark, sf_dir, "documents")).withColumnRenamed("grp", "lang")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations."""
    return convtrie.trie(convtrie.rebuilt(convtrie.turns(table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_hpylm_score": op1_hpylm_score,
    "op2_exact_topk": op2_exact_topk,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_probminhash": op4_probminhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_progressive_jpeg": op6_progressive_jpeg,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
    "op11_mixture_packing": op11_mixture_packing,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS MATERIALIZED (SELECT rid, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.rid AS other, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM u q JOIN u c ON q.i = c.i AND q.rid <> c.rid
  WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS r FROM s)
WHERE r <= 5""",
    "op5_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, text IS NULL AS gone FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
n AS (SELECT *, dense_rank() OVER (ORDER BY line) AS name FROM l),
s AS (SELECT doc_id, list(name ORDER BY i) AS names FROM n GROUP BY doc_id),
r AS (
  SELECT *, CASE WHEN lead(i, 3) OVER w IS NOT NULL THEN [name, lead(name, 1) OVER w, lead(name, 2) OVER w, lead(name, 3) OVER w] END AS run
  FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AND length(line) >= 50 AS copy1,
    run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS copy4,
    run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS many
  FROM r),
a AS (SELECT f.doc_id, i, copy4, names[i:] AS suffix FROM f JOIN s ON f.doc_id = s.doc_id WHERE many),
b AS (SELECT *, lag(suffix) OVER (ORDER BY suffix, doc_id, i) AS above, lead(suffix) OVER (ORDER BY suffix, doc_id, i) AS below FROM a),
m AS (
  SELECT doc_id, copy4,
    coalesce(list_position(list_transform(generate_series(1, least(len(suffix), len(above)) + 1), lambda k: k <= least(len(suffix), len(above)) AND suffix[k] = above[k]), false) - 1, 0) AS up,
    coalesce(list_position(list_transform(generate_series(1, least(len(suffix), len(below)) + 1), lambda k: k <= least(len(suffix), len(below)) AND suffix[k] = below[k]), false) - 1, 0) AS down
  FROM b),
t AS (SELECT doc_id, max(greatest(up, down)) AS longest FROM m WHERE copy4 GROUP BY doc_id),
g AS (SELECT *, copy1 OR bool_or(copy4) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS dead FROM f),
e AS (SELECT *, dead AND NOT coalesce(lag(dead) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM g),
k AS (
  SELECT doc_id, count(*) FILTER (dead) AS n_removed, count(*) FILTER (begins) AS n_runs, max(CAST(copy1 AS INT)) AS single,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dead), '')) AS kept_sha256 FROM e GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.gone THEN 0 ELSE len(d.lines) END AS n_lines, k.n_removed, k.n_runs, greatest(coalesce(t.longest, 0), k.single) AS longest_copy, k.kept_sha256
FROM d JOIN k ON d.doc_id = k.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op9_warc": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    1700000000 + coalesce(page_id, 0) % 4294967296 AS captured_at,
    split_part(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#', 1) AS rest
  FROM pages),
u AS (SELECT *, split_part(rest, '/', 1) AS host, rest[strlen(split_part(rest, '/', 1)) + 1:] AS path FROM p),
h AS (SELECT *, lower(split_part(string_split(host, '@')[-1], ':', 1)) AS name FROM u),
k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper,
    CASE WHEN rest IS NULL THEN '' ELSE array_to_string(list_reverse(string_split(name, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END END AS url_key
  FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to,
  url_key, CAST(captured_at AS BIGINT) AS captured_at,
  row_number() OVER (ORDER BY url_key, captured_at, page_id NULLS FIRST, payload_digest) - 1 AS position
FROM k""",
    "op12_collocations": r"""
WITH p AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, string_split(trim(regexp_replace(raw, '[\x20\x09]+', ' ', 'g')), ' ') AS w, count(*) AS m
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS raw FROM documents)
  WHERE regexp_matches(raw, '[^\x20\x09]') GROUP BY ALL),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase, m
  FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, CAST(sum(m) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
s AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, x.f AS l, y.f AS r, (1000000 * c.f * c.f) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(f) AS over FROM (SELECT lang, f, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
t AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE coalesce(100 * o.over < 50 * a, true))
SELECT t.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))) % 4 AS h
  FROM t),
q AS (SELECT h.conv_id, list_concat(coalesce(b.own[:h.h], []), h.own[h.h + 1:]) AS path FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM q),
v AS MATERIALIZED (
  SELECT path[:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
c AS (SELECT node[:depth - 1] AS node, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
w AS (
  SELECT v.*, coalesce(c.n_children, 0) AS n_children,
    (n_convs - 1) * CASE WHEN v.depth = 0 THEN 0 ELSE len(regexp_extract_all(v.node[v.depth].t, '[^\x20\x09-\x0D]+')) END AS own
  FROM v LEFT JOIN c ON c.node = v.node),
s AS (
  SELECT node[:k] AS node, sum(own) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT node, own, n_children, unnest(range(0, depth + 1)) AS k FROM w) GROUP BY ALL)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.node = w.node LEFT JOIN v u ON w.depth > 0 AND u.node = w.node[:w.depth - 1]""",
}
