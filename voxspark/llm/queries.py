"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chroma, decontam, divergence, langid, minhash, mixing, negatives, pii, quality, sharding, tokens, toxicity
from .scratch import Scratch

#: Key of the surrogates of op3. A deployment passes its own secret to ``pii.pseudonymise``.
DEMO_KEY = b"a key for tests and demonstrations only"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = toxicity.train(docs, _table(spark, sf_dir, "labels"), Scratch(spark, "op1"))
    return toxicity.classify(docs, net).withColumn("held_out", langid.held_out(F.col("doc_id")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), Scratch(spark, "op3"), DEMO_KEY)


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op4")
    folder = scratch.folder("tokens")
    manifest = tokens.write_tokens(_table(spark, sf_dir, "documents"), scratch, vocabulary("word_bpe_49k.json"), folder)
    return tokens.read_tokens(manifest, folder, tokens.crc32_of_ids, "long").withColumnRenamed("value", "ids_crc32")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op6_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    recordings = chroma.melodies(_table(spark, sf_dir, "embeddings"))
    queries = chroma.excerpts(recordings.filter(F.col("rec_id") % 100 == 0))
    return chroma.search(queries, recordings, Scratch(spark, "op6"))


def op7_shard_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, Scratch(spark, "op8"), vocabulary("piece_bpe_32k.model"))
    return langid.predict(docs, model).withColumn("held_out", langid.held_out(F.col("doc_id")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Scratch(spark, "op9"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    read = chat.read_back(chat.format_conversations(rows, chat.inst_template))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op11_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), Scratch(spark, "op11"))
    return quality.classify(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op12"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


_OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM words),
grams AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
classes AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN classes USING (doc_id)
"""

_OP5_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight
  FROM rows GROUP BY source),
levels AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2.0::DOUBLE * coalesce((sum(source_size) OVER before)::DOUBLE, 0) AS budget,
    (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS free
  FROM sources
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, budget * weight >= 2.0::DOUBLE * source_size * free AS capped FROM levels),
water AS (SELECT budget, free FROM flagged WHERE NOT capped ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN 2.0::DOUBLE * source_size
    ELSE (SELECT budget FROM water) * weight / (SELECT free FROM water) END AS target
  FROM flagged),
running AS (
  SELECT rows.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
    sum(size) OVER (PARTITION BY rows.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY rows.source, h) AS own
  FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN source_size > 0 AND upto + upto - own <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""


_OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>')) AS n,
    length(role) + len(regexp_extract_all(role, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>')) AS r
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE role WHEN 'user' THEN n + 18 WHEN 'assistant' THEN n + 6 ELSE n + r + 18 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


_OP12_SQL = """
WITH rows AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END)::BIGINT AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.q, r.q)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER best)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10
"""


_OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
uses AS (SELECT id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM uses GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
vocabulary AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM uses JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS size FROM counts GROUP BY ALL),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(size, 0) + v) AS p
  FROM groups JOIN kept USING (lang) JOIN vocabulary USING (lang) LEFT JOIN sizes USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 1)) // ((sum(sum(n)) OVER (PARTITION BY lang))::HUGEINT + any_value(v)) AS q
  FROM cells JOIN vocabulary USING (lang) GROUP BY lang, term),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS f
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed ON summed.lang = a.lang AND summed.source = a.source AND summed.item = b.source),
over_used AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM cells JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, (row_number() OVER best)::INT FROM over_used
WINDOW best AS (PARTITION BY lang, source ORDER BY value DESC, item) QUALIFY row_number() OVER best <= 200
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity_cnn": op1_toxicity_cnn,
        "op2_near_dedup": op2_near_dedup,
        "op3_pii_surrogates": op3_pii_surrogates,
        "op4_token_blocks": op4_token_blocks,
        "op5_mix_sources": op5_mix_sources,
        "op6_audio_fingerprints": op6_audio_fingerprints,
        "op7_shard_hilbert": op7_shard_hilbert,
        "op8_language_id": op8_language_id,
        "op9_decontaminate": op9_decontaminate,
        "op10_chat_format": op10_chat_format,
        "op11_quality_zstd": op11_quality_zstd,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": _OP2_SQL, "op5_mix_sources": _OP5_SQL, "op10_chat_format": _OP10_SQL, "op12_hard_negatives": _OP12_SQL, "op13_source_divergence": _OP13_SQL}
