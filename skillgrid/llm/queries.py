"""Registered queries of the training-data operators, with DuckDB twins where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from ..sources.tables import read_table
from . import decontaminate as DC
from . import hosts as HO
from . import negatives as NG
from . import packing as PK
from . import pages as PG
from . import phrases as PH
from . import quality as QL
from . import rollups as RL
from . import sharding as SD
from . import simhash as SH
from . import suffixes as SX
from . import tokenfiles as TF
from . import trie as TR
from .common import staged
from .tokens import Tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_FAILS = ("n_words < 10", "100 * n_repeat_words > 20 * n_words", "10 * n_symbols > n_words",
             "100 * n_dup_lines > 35 * n_lines", "10 * word_chars < 25 * n_words", "word_chars > 12 * n_words",
             "2 * n_capitals > n_latin", "n_words > 1000000")
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                  row_number() OVER () AS r FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
line_counts AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
                FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
win AS (SELECT r, unnest(generate_series(1, len(w) - 4)) AS p, w FROM d WHERE len(w) >= 5),
keyed AS (SELECT r, p, w[p:p+4] AS k FROM win),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS c FROM keyed) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT q) AS n_repeat_words
            FROM (SELECT r, unnest(generate_series(p, p + 4)) AS q FROM twice) GROUP BY r),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals,
             CAST(length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS BIGINT) AS n_latin
      FROM d LEFT JOIN line_counts USING (r) LEFT JOIN covered USING (r)),
f AS (SELECT *, CAST({' + '.join(f'(CASE WHEN {c} THEN {1 << b} ELSE 0 END)' for b, c in enumerate(OP1_FAILS))} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (fail_bits & {QL.STANDARD.mask}) = 0 AS kept, fail_bits FROM f"""


@register("op1_quality_rules", OP1_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document measured once into the rule ledger, then judged by the ``web@2`` policy."""
    rows = QL.apply_policy(QL.ledger(read_table(spark, sf_dir, "documents")), QL.STANDARD)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (F.col("fail_bits").bitwiseAND(F.lit(QL.BASE.mask)) != 0).alias("base_failed"), "kept", "fail_bits")


@register("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash (3-word shingles) and its group under links of 2 or fewer bits."""
    return SH.report(read_table(spark, sf_dir, "documents"), k=3, max_bits=2, seed=42)


@register("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts, equal texts drawn together by balanced label propagation."""
    return SD.shard(read_table(spark, sf_dir, "documents"), 16)


OP8_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _op8_sql() -> str:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v)
            for v, h, p in sorted(OP8_RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    longer = ", ".join(f"'{s}'" for s in HO.LONG_SUFFIXES)

    def level(name: str, source: str) -> str:
        return f"""{name}_s AS (SELECT 1 / least(0.5, greatest(0.0005, CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN
              (sum((bad - n * m) * (bad - n * m)) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)) ELSE 0 END)) - 1 AS s FROM {source}),
{name} AS (SELECT {source}.*, (bad + s * m) / (n + s) AS mean, n + s AS weight FROM {source}, {name}_s)"""
    return rf"""
WITH seen AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{HO.UPPER}', '{HO.LOWER}') AS host,
                     coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
marks AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
          FROM labels GROUP BY 1),
counts AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
           FROM seen LEFT JOIN marks USING (page_id) GROUP BY host),
bare AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l FROM counts),
known AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({longer}) THEN 2 ELSE 1 END AS k FROM bare),
cut AS (SELECT host, n, bad, array_to_string(l[-k:], '.') AS suffix, array_to_string(l[-(k + 1):], '.') AS domain FROM known),
suffix0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 20) FROM cut) AS m FROM cut GROUP BY suffix),
{level("suffixes", "suffix0")},
domain0 AS (SELECT c.*, s.mean AS m FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM cut GROUP BY 1, 2) c JOIN suffixes s USING (suffix)),
{level("domains", "domain0")},
host0 AS (SELECT cut.host, cut.n, cut.bad, d.mean AS m FROM cut JOIN domains d USING (domain)),
{level("hosts", "host0")}
SELECT page_id, host, path, {rule} AS rule,
       coalesce({verdict}, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.2 THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n AS BIGINT) AS host_labelled, CAST(bad AS BIGINT) AS host_bad
FROM seen LEFT JOIN hosts USING (host)"""


@register("op8_url_filter", _op8_sql())
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: the fixed rules', else its host's reputation.

    Stand-in for labelled page outcomes: the labels of equal ids, bad if quality is 0 or toxic is 1.
    """
    labels = read_table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return HO.judge(read_table(spark, sf_dir, "pages"), outcomes, OP8_RULES)


@register("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document streamed through the suffix automaton of all benchmark items, windows of 10 words."""
    return DC.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 10)


@register("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that also start in a document with a smaller id."""
    return PH.report(read_table(spark, sf_dir, "documents"), 50)


@register("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of 200-byte strings that start anywhere else too."""
    return SX.report(read_table(spark, sf_dir, "documents"), 200)


TOKENIZERS = [Tokenizer("byte_bpe_50k@1"), Tokenizer("byte_bpe_50k@2", collapse_space=True)]


@register("op5_token_rollups")
def op5_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after four committed batches.

    All documents of both versions are inserted; toxic ones are deleted; those
    of quality 0 get their version-2 count as revised version-1 count; and the
    first batch is committed once more, which changes nothing.  Labels stand in
    for a feed of changes.
    """
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    counts = staged(RL.counted_rows(staged(RL.token_counts(docs, TOKENIZERS), "rollup-tokens")), "rollup-counts")
    rollup = RL.TokenRollup(spark, scratch_path(spark, f"llm/rollup-{uuid.uuid4().hex}"))
    of = ("doc_id", "row", "copies", "source", "lang", "tokenizer")
    inserts = counts.select(*of, F.lit("insert").alias("op"), "n_tokens", F.lit(1).cast("long").alias("seq"))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    low = labels.where("quality = 0 AND toxic = 0").select("doc_id").distinct()
    revised = counts.where(F.col("tokenizer") == TOKENIZERS[1].version).join(low, "doc_id", "left_semi").withColumn("tokenizer", F.lit(TOKENIZERS[0].version))
    rollup.commit("insert", inserts)
    rollup.commit("toxic", inserts.join(toxic, "doc_id", "left_semi").withColumn("op", F.lit("delete")))
    rollup.commit("recount", revised.select(*of, F.lit("revise").alias("op"), "n_tokens", F.lit(1).cast("long").alias("seq")))
    rollup.commit("insert", inserts)
    return rollup.totals()


@register("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces in bins of 512, 1024, 2048 or 4096 tokens."""
    return PK.packed_documents(read_table(spark, sf_dir, "documents"))


@register("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return PG.main_text(read_table(spark, sf_dir, "pages"))


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, v.r, v.vec_id, v.label, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
      FROM v a JOIN v ON a.r <> v.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE label = al QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND s.label <> p.al AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5"""


@register("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five positives of every anchor (vec_id divisible by 100) and five hard negatives of each, labels of every seventh row moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = NG.quantised(read_table(spark, sf_dir, "embeddings"), label, 256)
    return NG.hard_negatives(rows, F.col("id") % 100 == 0, 5, 5, 80, 100)


# CRC-32 of a decimal: every character is mixed in, then eight shift steps (marked -1) follow
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
       lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"""
OP13_SQL = rf"""
WITH named AS (SELECT conv_id, turn, concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) AS t,
                      len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, t, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(t)) AS k FROM named),
ids AS (SELECT conv_id, {_CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (SELECT i.conv_id, 0 AS half, k, t, w FROM ids i JOIN turns b ON b.conv_id = i.conv_id - i.conv_id % 20 AND k <= h
            UNION ALL SELECT i.conv_id, 1, k, t, w FROM ids i JOIN turns o ON o.conv_id = i.conv_id AND k > h),
placed AS (SELECT conv_id, t, w, row_number() OVER (PARTITION BY conv_id ORDER BY half, k) AS depth FROM rebuilt),
hashed AS (SELECT conv_id, depth, w, sha256(string_agg(sha256(t), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM placed),
paths AS (SELECT conv_id, depth, w, node FROM hashed UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids),
sizes AS (SELECT conv_id, max(depth) AS size FROM paths GROUP BY conv_id),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
          FROM paths JOIN sizes USING (conv_id) GROUP BY node, depth),
links AS (SELECT DISTINCT c.node, p.node AS parent FROM paths c JOIN paths p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1),
fan AS (SELECT parent AS node, count(*) AS n_children FROM links GROUP BY parent),
spans AS (SELECT DISTINCT a.node AS node, d.node AS below FROM paths a JOIN paths d ON d.conv_id = a.conv_id AND d.depth >= a.depth),
sums AS (SELECT s.node, count(*) FILTER (WHERE f.n_children IS NULL) AS n_leaves, sum((d.n_convs - 1) * d.w) AS saved
         FROM spans s JOIN nodes d ON d.node = s.below LEFT JOIN fan f ON f.node = s.below GROUP BY s.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children,
       s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN fan f ON f.node = n.node LEFT JOIN links l ON l.node = n.node LEFT JOIN nodes p ON p.node = l.parent"""


@register("op13_conversation_trie", OP13_SQL)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie over all conversations, each restarted with up to three turns of the first of its twenty."""
    convs = TR.conversations(read_table(spark, sf_dir, "conversations"))
    opening = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    return TR.prefix_trie(TR.shared_openings(convs, 20, opening, 3))


TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.json"


@register("op12_token_files")
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to shard files and read back through the key index."""
    docs = read_table(spark, sf_dir, "documents")
    files = TF.TokenFiles.write(docs, scratch_path(spark, f"llm/token-files-{uuid.uuid4().hex}"), TF.FileTokenizer(TOKENIZER_FILE))
    return files.lookup(TF.document_keys(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
