"""Registered queries of the operators: ``opN_<name>`` over the whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprint, fixity, linededup, lm, maintext, manifest, neardup, prefixtrie, quality, runindex, secrets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % by


def vocabulary(spark: SparkSession, path: str | None = None) -> tuple[dict[bytes, int], str]:
    import public_tokenizers
    return bpe.read_ranks(spark, path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary(spark), decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=remainder("doc_id", 4) != 2)
    scored = quality.classify(docs, model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


@query
def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_covered", "coverage", F.size("tiles").alias("n_tiles"))


@query
def op3_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(secrets.listed(F.col("spans"), True), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans"), False).alias("spans"), number("guess"))


@query
def op2_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return cleaned.select("doc_id", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"),
                          F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("left_sha256"))


ORACLES["op2_line_hashing"] = rf"""
WITH cuts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{linededup.UNIT}') AS parts FROM documents),
pieces AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cuts),
plain AS (
  SELECT *, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t\n\x0B\f\r ]+', ' ', 'g')) AS norm FROM pieces),
joined AS (
  SELECT *, coalesce(sum(CASE WHEN (len(string_split(norm, ' ')) >= {linededup.LEAST} AND norm <> '') OR ends_with(part, chr(10)) THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM plain),
units AS (
  SELECT doc_id, u, string_agg(part, '' ORDER BY i) AS part, coalesce(string_agg(norm, ' ' ORDER BY i) FILTER (norm <> ''), '') AS norm FROM joined GROUP BY doc_id, u),
placed AS (SELECT doc_id, part, norm, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY u) AS stop FROM units),
ranked AS (
  SELECT *, len(string_split(norm, ' ')) >= {linededup.LEAST} AND norm <> ''
    AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, stop) > 1 AS gone
  FROM placed),
summed AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg((stop - length(part))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop) FILTER (gone), '') AS removed,
    coalesce(string_agg(part, '' ORDER BY stop) FILTER (NOT gone), '') AS kept
  FROM ranked GROUP BY doc_id)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, CAST(length(coalesce(kept, '')) AS BIGINT) AS n_chars_left,
  sha256(coalesce(kept, '')) AS left_sha256
FROM cuts LEFT JOIN summed USING (doc_id)
"""


@query
def op1_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = maintext.extract(pages.select("page_id", "url", "html"), *maintext.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# damage of the second copy: a changed character, a blanked page, and files that lack their end
_DAMAGE = """CASE WHEN page_id % 97 = 5 THEN concat(left(html, 9), '#', substring(html, 11, length(html) - 10))
  WHEN page_id % 101 = 7 THEN repeat(' ', CAST({size}(html) AS INT)) ELSE html END"""
_LOST = "page_id % 512 >= 480 AND floor(page_id / 512e0) % 7 = 3"


@query
def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    copy = pages.where(F.expr(f"NOT coalesce({_LOST}, false)")).withColumn("html", F.expr(_DAMAGE.format(size="octet_length")))
    found = fixity.audit(fixity.manifest(pages), fixity.manifest(copy))
    return found.select("file", "place", F.col("id").alias("page_id"), "start", "stop", "sha256", "replica_sha256", "state")


def _manifest_sql(name: str, rows: str) -> str:
    line = "chr(13) || chr(10)"
    return rf"""{name} AS (
  SELECT CAST(floor(page_id / 512e0) AS BIGINT) AS file, row_number() OVER w - 1 AS place, page_id, CAST(sum(strlen(body)) OVER w AS BIGINT) AS stop,
    strlen(body) AS size, sha256(body) AS sha256
  FROM (SELECT page_id, url, 'WARC/1.0' || {line} || 'WARC-Type: resource' || {line} || 'WARC-Target-URI: ' || coalesce(url, '') || {line}
      || 'Content-Length: ' || strlen(coalesce(html, '')) || {line} || {line} || coalesce(html, '') || {line} || {line} AS body FROM {rows})
  WINDOW w AS (PARTITION BY floor(page_id / 512e0) ORDER BY page_id ROWS UNBOUNDED PRECEDING))"""


ORACLES["op7_merkle_audit"] = f"""
WITH copy_pages AS (SELECT page_id, url, {_DAMAGE.format(size="strlen")} AS html FROM pages WHERE NOT coalesce({_LOST}, false)),
{_manifest_sql("a", "pages")}, {_manifest_sql("b", "copy_pages")}
SELECT a.file, a.place, a.page_id, a.stop - a.size AS start, a.stop, a.sha256, b.sha256 AS replica_sha256,
  CASE WHEN b.sha256 IS NULL THEN 'missing' ELSE 'changed' END AS state
FROM a LEFT JOIN b ON a.file = b.file AND a.place = b.place
WHERE b.sha256 IS NULL OR a.sha256 <> b.sha256 OR a.stop <> b.stop OR a.size <> b.size
"""


@query
def op6_recurrent_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.log_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 10) == 0)


@query
def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = runindex.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cleaned.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), gone.alias("n_removed"),
                          F.size("removed").cast("long").alias("n_spans"), F.sha2(F.coalesce("kept", F.lit("").cast("binary")), 256).alias("kept_sha256"))


ORACLES["op11_run_index"] = f"""
WITH texts AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, unnest(range(0, greatest(len(x) // 2 - {runindex.LEAST - 1}, 0), 256)) AS s, x FROM texts),
blocks AS MATERIALIZED (SELECT doc_id, s, substring(x, 2 * s + 1, {2 * (256 + runindex.LEAST - 1)}) AS y FROM starts),
windows AS (SELECT doc_id, s, y, unnest(range(len(y) // 2 - {runindex.LEAST - 1})) AS p FROM blocks),
cuts AS MATERIALIZED (SELECT doc_id, s + p AS p, substring(y, 2 * p + 1, {2 * runindex.LEAST}) AS bytes FROM windows),
named AS (SELECT doc_id, p, least FROM cuts JOIN (SELECT bytes, min(doc_id) AS least FROM cuts GROUP BY bytes) USING (bytes)),
hits AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {runindex.LEAST} THEN 0 ELSE 1 END AS opens FROM named WHERE least < doc_id),
runs AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hits),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + {runindex.LEAST} AS b FROM runs GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
summed AS (
  SELECT doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS stop, string_agg(substring(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN summed USING (doc_id)
"""


@query
def op12_time_forward_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    claim = F.when(remainder("doc_id", 5) == 0, manifest.leaf_hash(*before, lowered))
    return manifest.prove(docs.select("doc_id", "source", manifest.leaf_hash(*before, F.col("text")).alias("leaf"), claim.alias("claim")))


def _tree_sql(name: str, rows: str) -> str:
    """Recursive levels (g, level, pos, n, h) over rows (g, pos, n, h)."""
    return f"""{name} AS (
  SELECT g, 0 AS level, pos, n, h FROM {rows}
  UNION ALL
  SELECT g, max(level) + 1, pos // 16, max((n + 15) // 16), sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, pos // 16)"""


def _siblings_sql(name: str, tree: str) -> str:
    """What stands to the left and to the right of each node in its run."""
    run = "PARTITION BY g, level, pos // 16 ORDER BY pos ROWS BETWEEN"
    return f"""{name} AS (
  SELECT g, level, pos, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {tree} WHERE n > 1)"""


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"


# DuckDB has no crc32 of strings: the remainders of its polynomial, digit by digit and bit by bit
_CRC = """xor(list_reduce(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda c, d:
    list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, d)), CAST(4294967295 AS BIGINT)), 4294967295)"""

ORACLES["op12_time_forward_manifest"] = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '-') AS g, {_leaf_sql("text")} AS h,
    CASE WHEN {_CRC.format("doc_id")} % 5 = 0
      THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claim FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{_tree_sql("low", "placed")},
subroots AS MATERIALIZED (SELECT g AS part, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, 0 AS g FROM low WHERE n = 1),
{_tree_sql("high", "subroots")},
{_siblings_sql("low_sides", "low")}, {_siblings_sql("high_sides", "high")},
steps AS MATERIALIZED (
  SELECT p.g, p.pos, s.level, s.l, s.r FROM placed p JOIN low_sides s ON s.g = p.g AND s.pos = p.pos // CAST(power(16, s.level) AS BIGINT)
  UNION ALL
  SELECT p.g, p.pos, 1000 + s.level, s.l, s.r FROM placed p JOIN subroots t ON t.part = p.g JOIN high_sides s ON s.pos = t.pos // CAST(power(16, s.level) AS BIGINT)),
listed AS (SELECT g, pos, sha256(string_agg(l || r, '' ORDER BY level)) AS proof, list({{'l': l, 'r': r}} ORDER BY level) AS sides FROM steps GROUP BY g, pos),
folding AS (
  SELECT p.g, p.pos, 1 AS k, coalesce(p.claim, p.h) AS h, coalesce(sides, []) AS sides FROM placed p LEFT JOIN listed USING (g, pos)
  UNION ALL
  SELECT g, pos, k + 1, sha256(sides[k].l || h || sides[k].r), sides FROM folding WHERE k <= len(sides)),
whole AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, p.h AS leaf, t.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM placed p JOIN subroots t ON t.part = p.g LEFT JOIN listed ON listed.g = p.g AND listed.pos = p.pos
JOIN folding f ON f.g = p.g AND f.pos = p.pos AND f.k = len(f.sides) + 1 CROSS JOIN whole
"""


@query
def op13_prefix_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(prefixtrie.rebuilt(table(spark, sf_dir, "conversations")))


ORACLES["op13_prefix_slots"] = f"""
WITH turns AS MATERIALIZED (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j FROM conversations WHERE conv_id IS NOT NULL),
ids AS MATERIALIZED (SELECT c, c - c % 100 AS base, {_CRC.format("c")} % 6 AS h FROM (SELECT DISTINCT c FROM turns)),
given AS (SELECT ids.c, j AS i, role, text FROM ids JOIN turns ON turns.c = base AND j <= h),
kept AS (SELECT turns.c, j - h + coalesce(k, 0) AS i, role, text FROM turns JOIN ids ON ids.c = turns.c LEFT JOIN (SELECT c, count(*) AS k FROM given GROUP BY c) g ON g.c = turns.c WHERE j > h),
rows AS MATERIALIZED (
  SELECT c, i, length(text) AS size, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY i) AS key FROM (FROM given UNION ALL FROM kept)
  UNION ALL SELECT c, 0, 0, '' FROM ids),
nodes AS MATERIALIZED (
  SELECT key, i AS depth, any_value(size) AS size, count(*) AS n, min(c) AS c, left(key, greatest(length(key) - 64, 0)) AS above FROM rows GROUP BY key, i),
children AS MATERIALIZED (SELECT above AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
sums AS (
  SELECT r.key, sum((n - 1) * nodes.size) AS saved, count(*) FILTER (n_children IS NULL) AS leaves
  FROM nodes LEFT JOIN children USING (key) JOIN rows r ON r.c = nodes.c AND r.i <= nodes.depth GROUP BY r.key),
ends AS (
  SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT c, max_by(key, i) AS key FROM rows GROUP BY c) GROUP BY key)
SELECT a.c AS conv_id, CAST(a.depth AS BIGINT) AS depth, b.c AS parent_conv_id, a.n AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes a LEFT JOIN nodes b ON a.depth > 0 AND b.key = a.above LEFT JOIN children ON children.key = a.key JOIN sums ON sums.key = a.key LEFT JOIN ends ON ends.key = a.key
"""
