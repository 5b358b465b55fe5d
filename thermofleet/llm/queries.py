"""One query per operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermofleet.llm import bytebpe, lines, merkle, mixing, nearest, packing, phrases, quality, scoring, shards, simhash, substrings, suffixes
from thermofleet.llm.tables import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_source_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: which document is shown in which block and where."""
    shown = mixing.mixed(documents(spark, sf_dir))
    return shown.select(F.col("_row_key.doc_id").alias("doc_id"), "source", "block", "tokens", F.round("mix_at", 9).alias("mix_at"), F.round("weight", 9).alias("weight"))


def _span_digest(found: DataFrame) -> list:
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return [length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans")]


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", *_span_digest(found), F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), tokenizer_path(), with_ids=False)


@query("op4_backoff_scores")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(documents(spark, sf_dir))


_WORDS = r"'[^\x20\x09-\x0D]+'"
OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, {_WORDS}) AS ws FROM d),
tok AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
win AS (SELECT r, p, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS five
  FROM tok WINDOW o AS (PARTITION BY r ORDER BY p)),
h AS (SELECT r, p, count(*) OVER (PARTITION BY r, five) AS n FROM win WHERE five IS NOT NULL),
cov AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM h WHERE n > 1) GROUP BY r),
ln AS (SELECT r, sum(n - 1)::BIGINT AS n FROM (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, {_WORDS}) GROUP BY r, line) GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper
  FROM w LEFT JOIN ln ON ln.r = w.r LEFT JOIN cov ON cov.r = w.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 5 * n_symbols > n_words OR 4 * upper > word_chars
    OR word_chars > 40 * greatest(n_words, 1)) AS kept
FROM m
"""


@query("op5_quality_rules", OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(documents(spark, sf_dir))


@query("op6_simhash_groups")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.r, k.doc_id, k.line, k.p, coalesce(k.doc_id IS DISTINCT FROM hot.last_doc AND hot.key IS NOT NULL, false) AS lost
  FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


@query("op7_line_dedup", OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
tok AS (SELECT r, doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM d),
win AS (SELECT r, doc_id, p, {" || ' ' || ".join(f"lead(x, {k}) OVER o" for k in range(13))} AS k
  FROM tok WINDOW o AS (PARTITION BY r ORDER BY p)),
low AS (SELECT r, doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM win WHERE k IS NOT NULL),
cov AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS p FROM low WHERE least < doc_id),
m AS (SELECT tok.r, tok.x, tok.p, cov.p IS NOT NULL AS lost FROM tok LEFT JOIN cov ON cov.r = tok.r AND cov.p = tok.p),
a AS (SELECT r, count(*) FILTER (lost) AS n, string_agg(x, ' ' ORDER BY p) FILTER (NOT lost) AS t FROM m GROUP BY r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(a.n, 0)::BIGINT AS n_removed, sha256(coalesce(a.t, '')) AS kept_sha256
FROM d LEFT JOIN a ON a.r = d.r
"""


@query("op8_substring_dedup", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", _span_digest(found)[0], F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_virtual_slot_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.sharded(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


OP10 = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)])::BIGINT AS score
  FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op10_mtree_top_k", OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.top_k(rows, rows.where("vec_id % 100 = 0"))


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in fields) + ")"


OP12 = f"""
WITH RECURSIVE
crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT row_number() OVER () AS r, *, coalesce(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) & 1 = 1, false) AS touched
  FROM documents, crc),
leaf AS (SELECT r, doc_id, source, {_leaf("text")} AS leaf, CASE WHEN touched THEN {_leaf("replace(text, chr(10), '')")} END AS bad FROM d),
place AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaf),
tree(src, lvl, idx, h, n) AS (SELECT source, 0, idx, leaf, n FROM place
  UNION ALL SELECT src, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY src, lvl, idx // 3, n),
sub AS (SELECT src, h, row_number() OVER (ORDER BY src NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
top(lvl, idx, h, n) AS (SELECT 0, idx, h, n FROM sub
  UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, idx // 3, n),
near AS (SELECT r, t.lvl, t.h, t.idx, place.idx // (3 ** t.lvl)::BIGINT AS own FROM place JOIN tree AS t
    ON t.src IS NOT DISTINCT FROM place.source AND t.n > 1 AND t.idx // 3 = place.idx // (3 ** (t.lvl + 1))::BIGINT
  UNION ALL SELECT r, 1000 + t.lvl, t.h, t.idx, sub.idx // (3 ** t.lvl)::BIGINT FROM place JOIN sub ON sub.src IS NOT DISTINCT FROM place.source
    JOIN top AS t ON t.n > 1 AND t.idx // 3 = sub.idx // (3 ** (t.lvl + 1))::BIGINT),
step AS (SELECT r, lvl, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < own), '') AS a, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > own), '') AS b
  FROM near GROUP BY r, lvl),
path AS (SELECT r, string_agg(a || b, '' ORDER BY lvl) AS s, list(a || '|' || b ORDER BY lvl) AS steps FROM step GROUP BY r),
f AS (SELECT doc_id, leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(s, '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(bad, leaf), coalesce(steps, [])), lambda h, x: sha256(string_split(x, '|')[1] || h || string_split(x, '|')[2])) AS folded_root
  FROM place JOIN sub ON sub.src IS NOT DISTINCT FROM place.source LEFT JOIN path ON path.r = place.r)
SELECT *, folded_root = root AS verified FROM f
"""


@query("op12_merkle_manifest", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(documents(spark, sf_dir)).drop("source")


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    back = bytebpe.encoded(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, decode=True)
    return back.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pc AS (SELECT r, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (SELECT r, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS ps FROM d)),
tok AS (SELECT r, lang, p, unnest(ws) AS x, generate_subscripts(ws, 1) AS k FROM (SELECT r, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pc)),
g AS (SELECT lang, x AS w1, lead(x, 1) OVER o AS w2, lead(x, 2) OVER o AS w3 FROM tok WINDOW o AS (PARTITION BY r, p ORDER BY k)),
f AS (SELECT lang, w1 AS phrase, 1 AS words, count(*) AS n FROM g GROUP BY lang, w1
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL),
c AS (SELECT lang, phrase, words, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND n >= 10),
cut AS (SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, k, f.n AS l, h.n AS r, (1000000::HUGEINT * a * a) // (f.n::HUGEINT * h.n) AS score
  FROM cut JOIN f ON f.lang = cut.lang AND f.phrase = x JOIN f AS h ON h.lang = cut.lang AND h.phrase = y),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
over AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM c WHERE words = 3) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN over ON over.lang = low.lang AND over.phrase = low.phrase WHERE over.a IS NULL OR 100 * over.a < 50 * low.a),
n AS (SELECT lang, count(*) AS n FROM tok GROUP BY lang)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n AS n, score::BIGINT AS score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
"""


@query("op11_phrase_collocations", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))
