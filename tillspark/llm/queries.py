"""The registered queries of the subpackage and the SQL that recomputes those SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.llm import (
    bpe, chat, language, merkle, near_dups, packing, repeats, runs, token_counts, topk, toxicity, url_filter, vector_dups,
)
from tillspark.runtime import scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 512
MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: What both turns of conversation -7 say; fixed by the contract.
PROBE = r"\### Assistant: </turn> ok"


@query("op5_chat_format", rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
escaped AS (
  SELECT *, regexp_replace(replace(text, '\', '\b'), '<(/?(turn|attachment))', '\\l\1', 'g') AS shown,
    replace(regexp_replace(replace(role, '\', '\b'), '<(/?(turn|attachment))', '\\l\1', 'g'), chr(10), '\e') AS head
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(6 + length(head) + 1 + length(shown) + 8)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id""")
def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -7L AS conv_id, turn, role, text FROM VALUES (0L, 'user', :t), (1L, 'assistant', :t) AS v(turn, role, text)",
                      args={"t": PROBE})
    back = chat.read_back(chat.format_conversations(rows.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the limit."""
    counts = token_counts.count_tokens(table(spark, folder, "documents"), BYTE_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op6_packing")
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    pieces = packing.pack(table(spark, folder, "documents"), BYTE_BPE)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again: digests of the ids and of the bytes."""
    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digests(tokens: pa.Array) -> pa.Array:
        known, rows = bpe.bpe(MULTI_BPE), []
        for ids in tokens.field("ids"):
            ids = ids.values.to_numpy(zero_copy_only=False)
            rows.append({"n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                         "decoded_sha256": hashlib.sha256(known.decode(ids.tolist())).hexdigest()})
        return pa.array(rows, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    encoded = bpe.encode(table(spark, folder, "documents"), MULTI_BPE)
    return encoded.select("doc_id", digests("tokens").alias("d")).select("doc_id", "d.*")


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, folder, "documents")
    learned_from = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = language.learn(learned_from)
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of every document, learned from the labelled ones."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn_severity(docs, table(spark, folder, "labels")))


@query("op2_vector_near_dups")
def op2_vector_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    """Links of cosine 0.9 or more between all embeddings, and their components."""
    return vector_dups.near_duplicate_vectors(table(spark, folder, "embeddings"))


@query("op9_near_dups")
def op9_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose bags of five-word shingles overlap by 0.8 or more."""
    return near_dups.near_duplicates(table(spark, folder, "documents"))


@query("op10_top_k", """
WITH raw AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v::DOUBLE))) = 0),
whole AS (SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM raw),
scored AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.x, d.x)::BIGINT AS score
    FROM whole q JOIN whole d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER best)::INTEGER AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 5""")
def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five best other embeddings of every fiftieth, by whole-number inner product."""
    return topk.top_k(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


@query("op7_repeats")
def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes that lie in repeated strings of 400 bytes."""
    cut = repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return cut.select(
        "doc_id", size.alias("n_bytes"), (size - F.octet_length("cut.kept")).alias("n_removed"),
        F.size("cut.spans").cast("long").alias("n_spans"), F.sha2("cut.kept", 256).alias("kept_sha256"),
        (F.size("cut.spans") > 0).alias("has_repeats"))


def _repeating(docs: DataFrame) -> DataFrame:
    """One document in ten goes on with a stretch of its words over and over, as the contract of op11 says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.filter(h % 10 == 0).select("doc_id", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    chosen = chosen.withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    again = F.expr("array_join(transform(w, (x, i) -> IF(i < a, x, w[a + (i - a) % p])), ' ')")
    rest = docs.filter((h % 10 != 0) | F.col("doc_id").isNull()).select("doc_id", "text")
    return rest.unionByName(chosen.select("doc_id", again.alias("text")))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of words in every document, and the documents without their repeats."""
    found = runs.periodic_runs(_repeating(table(spark, folder, "documents").select("doc_id", "text"))).select("doc_id", "found.*")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period"),
        F.floor(1000 * best["length"] / -best["p"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: The rules of op12; fixed by the contract.
RULES = [url_filter.Rule(*r) for r in (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"))]

_REST = "CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
_HOST = "translate(regexp_extract(" + _REST + f", '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}')"
_PATH = "regexp_extract(" + _REST + ", '^[^/?#]*([^?#]*)', 1)"
_KEY = ("CASE WHEN strpos({u}, '://') > 0 THEN regexp_replace(" + _HOST + ", ':(80|443)$', '') || regexp_replace(" + _PATH + ", '/+$', '') || "
        "coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(" + _REST + r", '^[^?#]*\?([^#]*)', 1), '&'), "
        "lambda p: p <> '' AND NOT regexp_matches(p, '" + url_filter.TRACKING + "')), '&'), ''), '') END")


@query("op12_url_filter", rf"""
WITH RECURSIVE parts AS (SELECT page_id, url, html, coalesce({_HOST.format(u="url")}, '') AS host, coalesce({_PATH.format(u="url")}, '') AS path,
    {_KEY.format(u="url")} AS key FROM pages),
rules(verdict, host, path) AS (VALUES {", ".join(str(tuple(r)) for r in RULES)}),
found AS (SELECT p.*, r.host || r.path AS rule, r.verdict FROM parts p LEFT JOIN LATERAL (
    SELECT * FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    ORDER BY length(r.host || r.path) DESC LIMIT 1) r ON true),
tags AS (SELECT key, url, path, unnest(regexp_extract_all(html, '{url_filter.TAGS}', 1)) AS tag FROM found WHERE key IS NOT NULL),
named AS (SELECT *, replace(CASE WHEN regexp_matches(tag, '{url_filter.CANONICAL.replace("'", "''")}') THEN regexp_extract(tag, '{url_filter.HREF.replace("'", "''")}', 1)
    WHEN regexp_matches(tag, '{url_filter.REFRESH.replace("'", "''")}') THEN regexp_extract(tag, '{url_filter.TARGET.replace("'", "''")}', 1) ELSE '' END, '&amp;', '&') AS link,
    regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site FROM tags),
links AS (SELECT key, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || link WHEN starts_with(link, '/') THEN site || link
    WHEN starts_with(link, '#') OR regexp_matches(link, '{url_filter.SCHEME}') THEN NULL WHEN starts_with(link, '?') THEN site || path || link
    ELSE site || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || link END AS target FROM named WHERE link <> ''),
edges AS (SELECT key AS a, {_KEY.format(u="target")} AS b FROM links WHERE target IS NOT NULL),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reached(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reached r JOIN both_ways w ON w.a = r.b),
aliases AS (SELECT a, b FROM reached UNION SELECT key, key FROM found WHERE key IS NOT NULL),
told AS (SELECT a AS key, bool_or(f.verdict = 'block') AND NOT coalesce(bool_or(f.verdict = 'allow'), false) AS bad
    FROM aliases JOIN found f ON f.key = b GROUP BY a)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM found LEFT JOIN told USING (key)""")
def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page by rules, and by the aliases that redirects and canonical links make."""
    return url_filter.judge(table(spark, folder, "pages"), RULES)


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


@query("op13_merkle_manifest", rf"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_sql_leaf("n_chars::HUGEINT + 1")} ELSE {_sql_leaf("n_chars")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low(lang, lvl, pos, h, n) AS (SELECT lang, 0, pos, leaf, n FROM placed
    UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM low WHERE n > 1 GROUP BY lang, lvl, pos // 2),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS m FROM low WHERE n = 1),
high(lvl, pos, h, n) AS (SELECT 0, place, subroot, m FROM subs
    UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM high WHERE n > 1 GROUP BY lvl, pos // 2),
heights AS (SELECT lang, max(lvl) AS height FROM low GROUP BY lang),
steps AS (
    SELECT p.doc_id, p.leaf, p.lang, p.pos, l.lvl, (p.pos >> l.lvl) & 1 AS side, s.h FROM placed p
    JOIN (SELECT DISTINCT lang, lvl FROM low WHERE n > 1) l ON l.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = l.lvl AND s.pos = xor(p.pos >> l.lvl, 1)
    UNION ALL
    SELECT p.doc_id, p.leaf, p.lang, p.pos, g.height + l.lvl, (b.place >> l.lvl) & 1, s.h FROM placed p
    JOIN heights g ON g.lang IS NOT DISTINCT FROM p.lang JOIN subs b ON b.lang IS NOT DISTINCT FROM p.lang
    CROSS JOIN (SELECT DISTINCT lvl FROM high WHERE n > 1) l LEFT JOIN high s ON s.lvl = l.lvl AND s.pos = xor(b.place >> l.lvl, 1)),
proofs AS (SELECT lang, pos, sha256(coalesce(string_agg(h, '' ORDER BY lvl), '')) AS proof_sha256, list(struct_pack(side := side, h := h) ORDER BY lvl) AS way
    FROM steps GROUP BY lang, pos),
fold(lang, pos, lvl, h) AS (SELECT lang, pos, 0, changed FROM placed
    UNION ALL SELECT f.lang, f.pos, f.lvl + 1, sha256(CASE WHEN way[f.lvl + 1].side = 1 THEN coalesce(way[f.lvl + 1].h, '') || f.h
        ELSE f.h || coalesce(way[f.lvl + 1].h, '') END)
    FROM fold f JOIN proofs p ON p.lang IS NOT DISTINCT FROM f.lang AND p.pos = f.pos WHERE f.lvl < len(way)),
ends AS (SELECT lang, pos, arg_max(h, lvl) AS folded_root FROM fold GROUP BY lang, pos),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, b.subroot, root.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM placed p JOIN subs b ON b.lang IS NOT DISTINCT FROM p.lang CROSS JOIN root
LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos
JOIN ends e ON e.lang IS NOT DISTINCT FROM p.lang AND e.pos = p.pos""")
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, its proof, and whether what it may have become still folds to the root."""
    docs = table(spark, folder, "documents")

    def leaf(n_chars):
        return merkle.leaf(*map(F.col, ("doc_id", "source", "lang")), n_chars, F.col("text"))

    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    changed = F.when(touched, leaf(F.col("n_chars").cast("decimal(38,0)") + 1)).otherwise(F.col("leaf"))
    leaves = docs.withColumn("leaf", leaf(F.col("n_chars"))).select("doc_id", F.col("lang").alias("part"), "leaf", changed.alias("changed"))
    with scratch(spark) as job:
        kept = merkle.manifest(leaves, ["doc_id"])
        digests = F.sha2(F.array_join(F.transform("proof", lambda s: F.substring(s, 2, 64)), ""), 256)
        return job.keep(kept.select("doc_id", "leaf", "subroot", "root", digests.alias("proof_sha256"), F.col("version_root").alias("folded_root"),
                                    (F.col("version_root") == F.col("root")).alias("verified")))
