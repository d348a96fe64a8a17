"""The queries of this subpackage: thin digests over the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import bpe, chat_format, decontaminate, exact_dedup, hard_negatives, html_extract, jaccard_join, lang_id, license_scan, line_dedup, merkle, secret_scan, sharding


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.MARKOV)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        _sha(said(base)).alias("base_sha256"), said(F.col("spans")).alias("spans"), count(secret_scan.MARKOV).alias("n_markov"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), either AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reached JOIN either ON a = other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.removed_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc.doc_id", F.col("lines").cast("long").alias("n_lines"), F.col("removed").cast("long").alias("n_removed"), _sha(F.coalesce("text", F.lit(""))).alias("text_sha256"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extract.extract(_read(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

def tokenizer_path() -> str:
    """The word-end vocabulary's place among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(_read(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        _sha(F.col("decoded")).alias("decoded_sha256"),
    )


#: A conversation whose texts hold the control strings.
CONFLICT = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"))
    template = chat_format.Template()
    rows = chat_format.format_chats(table.unionByName(extra), template)
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: chat_format.unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]), template))
    loss = F.array_join(masked, "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _sha(turns).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        _sha(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(role) + length(text) + 6 + 7 + 4) + 3 AS plain,
         bool_or(regexp_matches(role || ' ' || text, '<s>|\\[INST\\]|\\[/INST\\]|</s>|␛')) AS clash,
         sum(length(regexp_replace(role || ' ' || text, '<s>|\\[INST\\]|\\[/INST\\]|</s>|␛', 'x\\0', 'g')) - length(role || ' ' || text)) AS more
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(plain + CASE WHEN clash THEN more ELSE 0 END AS BIGINT) AS formatted_chars
FROM whole
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP8_SQL = """
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT side, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM texts
), grams AS (
  SELECT DISTINCT side, id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT id, count(*) AS n_item FROM grams WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM grams d JOIN grams b ON d.g = b.g AND d.side = 'd' AND b.side = 'b' JOIN sizes ON sizes.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.75 * any_value(n_item)
"""


def op9_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = lang_id.train(lang_id.training_texts(docs))
    return lang_id.label(docs, model).select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan_licenses(_read(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    more = F.transform("found", lambda p: p["label"])
    said = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda p: p["score"])), F.lit(0.0))
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        said(base).alias("base_labels"), said(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.place(_read(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.usable(table.select("vec_id", label.alias("label"), "embedding"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS place
  FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score)
WHERE place <= 3
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = F.when(tampered, merkle.document_leaf(F.col("n_chars") + 1))
    rows = merkle.manifest(docs.select("doc_id", "lang", merkle.document_leaf(F.col("n_chars")).alias("leaf"), changed.alias("changed")))
    folded = merkle.fold(F.coalesce("row.changed", "leaf"), F.col("path"))
    rows = rows.select("row.doc_id", "leaf", "subroot", "root", merkle.digest(F.array_join("path.digest", "")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, source, lang, n_chars, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx,
         xor(list_reduce([4294967295] || flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [CAST(ascii(substr(doc_id::VARCHAR, i::INT, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
                         lambda x, e: xor(xor(x, e) >> 1, 3988292384 * (xor(x, e) & 1))), 4294967295) % 7 = 0 AS picked
  FROM documents
), parts AS (
  SELECT doc_id, lang, idx, picked, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(text) || ':' || text, '-') AS z FROM rows
), leaves AS (
  SELECT doc_id, lang, idx, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
         CASE WHEN picked AND n_chars IS NOT NULL THEN sha256(a || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || z) END AS changed FROM parts
), low AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS d FROM leaves GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, len(d), 2), lambda i: sha256(d[i + 1] || coalesce(d[i + 2], ''))) FROM low WHERE len(d) > 1
), subroots AS (SELECT lang, d[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM low WHERE len(d) = 1),
high AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS d FROM subroots
  UNION ALL SELECT level + 1, list_transform(range(0, len(d), 2), lambda i: sha256(d[i + 1] || coalesce(d[i + 2], ''))) FROM high WHERE len(d) > 1
), steps AS (
  SELECT doc_id, level, (idx >> level) & 1 AS side, low.d[xor(idx >> level, 1) + 1] AS sister FROM leaves JOIN low ON low.lang IS NOT DISTINCT FROM leaves.lang AND len(low.d) > 1
  UNION ALL SELECT doc_id, 1000 + level, (place >> level) & 1, high.d[xor(place >> level, 1) + 1]
  FROM leaves JOIN subroots ON subroots.lang IS NOT DISTINCT FROM leaves.lang JOIN high ON len(high.d) > 1
), paths AS (SELECT doc_id, coalesce(string_agg(sister, '' ORDER BY level), '') AS proof, list({'side': side, 'sister': coalesce(sister, '')} ORDER BY level) AS path FROM steps GROUP BY doc_id),
fold AS (
  SELECT doc_id, coalesce(changed, leaf) AS now, path, 1 AS pos FROM leaves JOIN paths USING (doc_id)
  UNION ALL SELECT doc_id, sha256(CASE WHEN path[pos].side = 1 THEN path[pos].sister || now ELSE now || path[pos].sister END), path, pos + 1 FROM fold WHERE pos <= len(path)
)
SELECT l.doc_id, l.leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified
FROM leaves l JOIN paths USING (doc_id) JOIN fold ON fold.doc_id = l.doc_id AND pos = len(fold.path) + 1
JOIN subroots ON subroots.lang IS NOT DISTINCT FROM l.lang, (SELECT d[1] AS root FROM high WHERE len(d) = 1)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_line_dedup": op3_line_dedup,
        "op4_html": op4_html,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_bpe": op6_bpe,
        "op7_chat_format": op7_chat_format,
        "op8_decontaminate": op8_decontaminate,
        "op9_lang_id": op9_lang_id,
        "op10_licenses": op10_licenses,
        "op11_sharding": op11_sharding,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op7_chat_format": OP7_SQL, "op8_decontaminate": OP8_SQL, "op12_hard_negatives": OP12_SQL, "op13_merkle": OP13_SQL}
