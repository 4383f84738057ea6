"""Registered queries of the URL, chat, mixing and sharding operators, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearby_engine.llm import chat_format, hash_tree, mixing, simhash, url_cascade
from nearby_engine.llm.registry import register, table

# --- op1: URL filters ----------------------------------------------------------------------------------------------------

ALLOW = ["org/", "com/fr/"]
BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]
#: Host list of the query: these names under the three top domains.
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_HOSTS = [f"{name}.example.{top}" for name in LISTED_NAMES for top in ("com", "net", "org")]


def _values(keys: list[str], extra: str = "") -> str:
    return ", ".join(f"('{k}'{extra})" for k in keys)


OP1_SQL = rf"""
WITH rules(rule, verdict) AS (VALUES {_values(ALLOW, ", 'allow'")}, {_values(BLOCK, ", 'block'")}),
listed(host) AS (VALUES {_values(LISTED_HOSTS)}),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{url_cascade.UPPER}', '{url_cascade.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
hosts AS (SELECT DISTINCT host FROM parts),
bad AS (SELECT h.host FROM hosts h JOIN listed l ON h.host = l.host OR ends_with(h.host, '.' || l.host) GROUP BY 1),
fits AS (
  SELECT page_id, p.host, path, rule, verdict, row_number() OVER (PARTITION BY page_id, p.host, path ORDER BY length(rule) DESC, rule DESC) AS n
  FROM (SELECT DISTINCT page_id, host, path FROM parts) p JOIN rules
    ON (p.host = split_part(rule, '/', 1) OR ends_with(p.host, '.' || split_part(rule, '/', 1)))
   AND starts_with(path, substr(rule, length(split_part(rule, '/', 1)) + 1)))
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON f.n = 1 AND f.page_id = p.page_id AND f.host = p.host AND f.path = p.path
LEFT JOIN bad b ON b.host = p.host
"""


@register("op1_url_cascade", OP1_SQL)
def op1_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by host and path rules, and by a host list where no rule fits."""
    keys = lambda values: url_cascade.key_table(spark, values)
    return url_cascade.judge(table(spark, sf_dir, "pages"), keys(ALLOW), keys(BLOCK), keys(LISTED_HOSTS))


# --- op3: chat formatting ------------------------------------------------------------------------------------------------

PROBE = "</s>[INST] ok [/INST]"
_CONTROL_SQL = "|".join(
    rf"{c}\\*(?:{'|'.join(''.join(chr(92) + x if x in '|[]<>/' else x for x in r) for f, r in chat_format.CONTROL if f == first)})"
    for first, c in (("<", "<"), ("[", r"\["))
)
OP3_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
sized AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL_SQL}'))
    + len(regexp_extract_all(text, '{_CONTROL_SQL}')) + {len(chat_format.TURN + chat_format.TEXT + chat_format.END)} AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@register("op3_chat_format", OP3_SQL)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, laid out by turn, and one of the messages layout, formatted and read back."""
    message = lambda role: F.struct(F.lit(role).alias("role"), F.lit(PROBE).alias("content"))
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(message("user"), message("assistant")).alias("messages"))
    by_turn = chat_format.canonical_turns(table(spark, sf_dir, "conversations"))
    turns = by_turn.unionByName(chat_format.canonical_turns(probe))
    return chat_format.digests(chat_format.format_turns(turns))


# --- op6: mixing ---------------------------------------------------------------------------------------------------------

OP6_SQL = r"""
WITH slim AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source),
weighed AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w FROM per),
ranked AS (
  SELECT *, coalesce(sum(3.0e0 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS most_before,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    sum(source_size) OVER () AS total FROM weighed),
level AS (SELECT arg_min((total - most_before) / w_left, source_size / w) AS share FROM ranked WHERE 3.0e0 * source_size >= w * ((total - most_before) / w_left)),
rates AS (SELECT source, source_size, least(3.0e0 * source_size, w * share) AS target,
    CASE WHEN source_size > 0 THEN least(least(3.0e0 * source_size, w * share) / source_size, 3.0e0) ELSE 0 END AS rate FROM weighed, level),
drawn AS (SELECT *, CAST(CAST('0x' || substr(md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0e0 AS u FROM slim)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
"""


@register("op6_source_mixing", OP6_SQL)
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3 in turn, at most three times each."""
    return mixing.plan_mix(table(spark, sf_dir, "documents"), (1, 2, 3), 3.0)


# --- op9: sharding -------------------------------------------------------------------------------------------------------

TREE = hash_tree.balanced_tree(8)
GROWN = hash_tree.grow(TREE, 8)


def _sql_shard(node: hash_tree.Node) -> str:
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _sql_shard(node.children[0])
    score = lambda c: (
        f"(-ln((CAST(CAST('0x' || substr(md5(k || '/{c.name}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496.0e0) / {float(c.weight)}e0)"
    )
    least = "least(" + ", ".join(map(score, node.children)) + ")"
    return "CASE " + " ".join(f"WHEN {score(c)} = {least} THEN {_sql_shard(c)}" for c in node.children) + " END"


OP9_SQL = f"""
WITH slim AS (SELECT doc_id, text, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, CAST(doc_id AS VARCHAR) AS k FROM documents),
placed AS (SELECT doc_id, size, CAST({_sql_shard(TREE)} AS INTEGER) AS shard, CAST({_sql_shard(GROWN)} AS INTEGER) AS grown_shard FROM slim)
SELECT doc_id, size, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM placed
"""


@register("op9_hash_tree")
def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of two regions, and where they go with a ninth."""
    return hash_tree.assign(table(spark, sf_dir, "documents"), TREE, GROWN)


# --- op10: document fingerprints -----------------------------------------------------------------------------------------


@register("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document fingerprinted, with its edited text and its next document."""
    return simhash.fingerprint_documents(table(spark, sf_dir, "documents"))
