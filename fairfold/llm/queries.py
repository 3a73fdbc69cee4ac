"""Registered queries of the text operators, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairfold.llm import (
    chat_format, decontaminate, exact_dedup, license_scan, line_dedup, lm_score, merkle, ngram_join, packing, periodic, phrase_dedup,
    sentencepiece_codec, toxicity,
)
from fairfold.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_license_scan")
def op1(spark, sf_dir):
    """Documents as files of a tree: source, then thousands and hundreds of doc_ids as directories."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id")
    path = F.concat_ws("/", F.lit(""), "source", F.floor(number / 1000).cast("string"), F.floor(number / 100).cast("string"), number.cast("string"))
    found = license_scan.scan(docs.select(path.alias("path"), "text"))
    return found.withColumn("doc_id", F.element_at(F.split("path", "/"), -1).cast("long"))


@query("op2_ngram_jaccard_join")
def op2(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark, sf_dir):
    return toxicity.scores(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


@query("op4_chat_format", r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), s AS (
  SELECT t.*, speaker, CAST(floor(turn / 64) AS BIGINT) AS segment,
         CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user:' || role || '|>' END || chr(10) AS tag
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, row_number() OVER w AS rn,
         CAST(sum(length(tag) + length(text) + 8) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(text) - 8 AS begins
  FROM s WINDOW w AS (PARTITION BY conv_id, speaker, segment ORDER BY turn, role, text)
)
SELECT conv_id, speaker, segment, count(*) AS n_turns,
       sha256(string_agg(tag || text || '<|end|>' || chr(10), '' ORDER BY rn)) AS text_sha256,
       coalesce(string_agg(begins || '-' || (begins + length(text)), ',' ORDER BY rn) FILTER (WHERE role = speaker), '') AS masks
FROM o GROUP BY ALL
""")
def op4(spark, sf_dir):
    out = chat_format.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return out.select("conv_id", "speaker", "segment", "n_turns", F.sha2("text", 256).alias("text_sha256"), F.array_join(spans, ",").alias("masks"))


@query("op5_phrase_dedup", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (
    SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (k) WHERE f < doc_id) GROUP BY doc_id
), parts AS (
  SELECT doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM parts
""")
def op5(spark, sf_dir):
    return phrase_dedup.without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query("op6_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
""")
def op6(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op7_sentencepiece_codec")
def op7(spark, sf_dir):
    return sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents"))


@query("op8_line_dedup")
def op8(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_lm_score")
def op9(spark, sf_dir):
    return lm_score.text_scores(table(spark, sf_dir, "documents"), class_column="lang")


@query("op10_benchmark_decontamination", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), hits AS (
  SELECT doc_id, i, x.n, item_id FROM (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)) x
  JOIN win ON win.k = x.k AND win.n = x.n
), n_hit AS (
  SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), of_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS c, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit.c, 0) AS n_hit, coalesce(of_items.c, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit.c, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN of_items USING (doc_id)
""")
def op10(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


# crc32 of the decimal doc_id, byte by byte: the table is the polynomial's, eight steps for each value
CRC32 = """
table32 AS (
  SELECT list(list_reduce(list_concat([n], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS t FROM range(256) r(n)
), crc AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                 lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM (SELECT DISTINCT doc_id FROM documents), table32
)"""


def _leaf_sql(text: str) -> str:
    def part(c: str) -> str:
        return f"coalesce(strlen({c}) || ':' || {c}, '-')"

    return "sha256(" + " || ".join(map(part, ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))) + ")"


@query("op11_merkle_manifest", f"""
WITH RECURSIVE {CRC32}, leaves AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN h % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
  FROM documents JOIN crc USING (doc_id)
), trees AS (
  SELECT source, 0 AS l, list(leaf ORDER BY pos) AS a FROM leaves GROUP BY source
  UNION ALL
  SELECT source, l + 1, list_transform(range(0, (len(a) + 2) // 3), lambda i: sha256(array_to_string(a[3 * i + 1 : 3 * i + 3], ''))) FROM trees WHERE len(a) > 1
), subroots AS (
  SELECT source, a[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM trees WHERE len(a) = 1
), tops AS (
  SELECT 0 AS l, list(subroot ORDER BY pos) AS a FROM subroots
  UNION ALL
  SELECT l + 1, list_transform(range(0, (len(a) + 2) // 3), lambda i: sha256(array_to_string(a[3 * i + 1 : 3 * i + 3], ''))) FROM tops WHERE len(a) > 1
), heights AS (SELECT source, max(l) AS height FROM trees GROUP BY source
), steps AS (
  SELECT t.source, CAST(NULL AS BIGINT) AS at, t.l, a FROM trees t WHERE len(a) > 1
  UNION ALL
  SELECT source, s.pos AS at, height + l, a FROM tops, subroots s JOIN heights USING (source) WHERE len(a) > 1
), walk AS (
  SELECT doc_id, leaves.source, leaves.pos AS idx, s.pos AS sub, 0 AS l, coalesce(changed, leaf) AS acc, '' AS proof
  FROM leaves JOIN subroots s ON leaves.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT doc_id, source, i // 3, sub, l + 1, sha256(lhs || acc || rhs), proof || lhs || rhs FROM (
    SELECT w.*, i, array_to_string(a[3 * (i // 3) + 1 : i], '') AS lhs, array_to_string(a[i + 2 : 3 * (i // 3) + 3], '') AS rhs FROM (
      SELECT w.*, s.a, CASE WHEN s.at IS NOT NULL AND w.l = h.height THEN s.at ELSE w.idx END AS i
      FROM walk w JOIN steps s ON s.source IS NOT DISTINCT FROM w.source AND s.l = w.l JOIN heights h ON h.source IS NOT DISTINCT FROM w.source) w)
), ends AS (SELECT doc_id, arg_max(acc, l) AS folded_root, arg_max(proof, l) AS proof FROM walk GROUP BY doc_id
)
SELECT doc_id, leaf, subroot, a[1] AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = a[1] AS verified
FROM leaves JOIN subroots s ON leaves.source IS NOT DISTINCT FROM s.source JOIN ends USING (doc_id), tops WHERE len(a) = 1
""")
def op11(spark, sf_dir):
    """Where 2 divides crc32 of the doc_id, the text is read without its line feeds when the leaf is proved."""
    fields = [F.col(c) for c in merkle.FIELDS[:-1]]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(tampered, merkle.leaf(*fields, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    out = merkle.manifest(table(spark, sf_dir, "documents").withColumn("changed", changed), ["changed"])
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                     merkle.folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    """Texts of which a tenth repeat a passage to their end (``periodic.repeated_tail``)."""
    docs = table(spark, sf_dir, "documents")
    found = periodic.periodic_runs(docs.select("doc_id", periodic.repeated_tail(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


@query("op13_sequence_packing")
def op13(spark, sf_dir):
    import public_tokenizers

    out = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
