"""The registered query of each corpus operator, over whole tables with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import with_alignment
from .common import table
from .decontaminate import benchmark_hits
from .mpeg import FEATURES, media_column, media_features
from .packing import packed
from .sharding import kd_tree, with_slots
from .lines import without_boilerplate
from .neardup import with_class
from .quality import with_quality
from .repair import beside, damaged, digests, report
from .simhash import with_component
from .substrings import without_repeats
from .toxicity import fit, held_out, scored
from .warc import archived


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    return scored(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


_OP2_SQL = r"""
WITH own AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM own WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM own),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT o.doc_id, CAST(len(o.w) AS BIGINT) AS n_words, CAST(len(o.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM own o LEFT JOIN kept k USING (doc_id)
"""


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archived(table(spark, sf_dir, "pages"))
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS original FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < original THEN original END AS refers_to
FROM m
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return without_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


_OP4_SQL = r"""
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
own AS (SELECT DISTINCT r, source, line FROM (SELECT r, source, trim(translate(unnest(lines), chr(13) || chr(9), '  ')) AS line FROM cut) WHERE line <> ''),
totals AS (SELECT source, count(*) AS pages FROM cut GROUP BY source),
drops AS (
  SELECT o.source, list(o.line) AS lines FROM (SELECT source, line, count(*) AS n FROM own GROUP BY source, line) o
  JOIN totals t ON o.source IS NOT DISTINCT FROM t.source WHERE o.n >= 3 AND o.n > 0.1::DOUBLE * t.pages GROUP BY o.source),
kept AS (
  SELECT c.doc_id, c.text, c.lines,
    CASE WHEN d.lines IS NULL THEN c.lines ELSE list_filter(c.lines, lambda x: NOT list_contains(d.lines, trim(translate(x, chr(13) || chr(9), '  ')))) END AS k
  FROM cut c LEFT JOIN drops d ON c.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(k), 0) AS BIGINT) AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(k, chr(10)), '') END AS text
FROM kept
"""


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_OP5_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
pieces AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM pieces),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM low, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.s, p.n, i.item FROM places p JOIN pieces i USING (n, words)),
words_hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM hits) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(o.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM low l LEFT JOIN words_hit h USING (doc_id) LEFT JOIN owners o USING (doc_id)
"""


def op6_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_class(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = with_slots(kd_tree(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))
    return sharded.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_column(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return media_features(stored).select("doc_id", *FEATURES.names)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op11_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_component(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, mended = report(damaged(rows), rows)
    empty = F.sha2(F.lit(""), 256)
    return beside(found, digests(mended)).withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_warc_revisits": op3_warc_revisits,
        "op4_line_dedup": op4_line_dedup,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_minhash_classes": op6_minhash_classes,
        "op7_kd_sharding": op7_kd_sharding,
        "op8_packing": op8_packing,
        "op9_mpeg_audio": op9_mpeg_audio,
        "op10_quality": op10_quality,
        "op11_simhash_components": op11_simhash_components,
        "op12_token_alignment": op12_token_alignment,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": _OP2_SQL,
        "op3_warc_revisits": _OP3_SQL,
        "op4_line_dedup": _OP4_SQL,
        "op5_benchmark_decontamination": _OP5_SQL,
    }
