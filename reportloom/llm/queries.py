"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, lm, merkle, ngram_join, pii, quality, repair, secrets, sentpiece, simhash, tokenfile
from .common import held_out, table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "lost", F.sha2("cleaned", 256).alias("cleaned_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out("doc_id", 4)))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score", "rejected")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no pairs: a conversation is chosen over its variant whose last assistant turn repeats the turn before."""
    whole = chat.conversations(table(spark, sf_dir, "conversations"))
    out = chat.format_preferences(whole.select("conv_id", F.col("turns").alias("chosen"), chat.echoed(F.col("turns")).alias("rejected")))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", told("chosen_mask").alias("chosen_mask"), told("rejected_mask").alias("rejected_mask"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_table(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), pii.key_of(spark))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    out = sentpiece.decode(sentpiece.encode(table(spark, sf_dir, "documents"), model), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = secrets.scan(docs, secrets.train_field(docs))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return out.select("doc_id", *map(count, secrets.KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), "n_tagged")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    odd = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    text = F.when(odd, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = merkle.leaf_digest(text if c == "text" else F.col(c) for c in merkle.FIELDS)
    out = merkle.manifest(docs, also={"tampered": tampered})
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), merkle.folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(told("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("alive"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))))
    return repair.repair(rows, alive=F.col("alive"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_simhash": op4_simhash,
    "op5_preference_chat": op5_preference_chat,
    "op6_token_files": op6_token_files,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontamination": op9_decontamination,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

#: crc32 of a text of ASCII characters.
_CRC32 = lambda text: f"""xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT),
                lambda crc, byte: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(crc, byte)), 4294967295), 4294967295)"""  # noqa: E731


def _repair_sql() -> str:
    """Costs, audits and lines of the cheapest edits for each state (start, after s, u, a), row by row."""
    least = lambda *of: f"list_sort(list_filter([{', '.join(of)}], lambda x: x IS NOT NULL))[1]"
    more = lambda s, cost, edit, line=None: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': " + (f"list_append({s}.t, {line})" if line else f"{s}.t") + "} END"
    insert = lambda s, role: more(s, 3, "I", f"'{role}:'")
    rerole = lambda s, role: f"CASE WHEN NOT gone THEN {more(s, '3 + cut', 'R', f"'{role}:' || text")} END"
    keep = lambda s, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {more(s, 'cut', 'K', "role || ':' || text")} END"
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k, unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS u(copy)),
n AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS initial_before,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (
  SELECT *, trimmed = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(trimmed, 1) NOT IN ('.', '!', '?') AS short
  FROM n),
r AS (SELECT *, blank OR again AS gone, CASE WHEN short AND NOT blank AND NOT again THEN 3 ELSE 0 END AS cut FROM f),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, i, {more('s0', 4, 'D')}, {least(more('s1', 4, 'D'), keep('s0', 's'))},
         {least(more('s2', 4, 'D'), *(g(s, x) for s in ('s0', 's1', 's3') for g, x in ((keep, 'u'), (rerole, 'user'))))},
         {least(more('s3', 4, 'D'), keep('s2', 'a'), rerole('s2', 'assistant'))}
  FROM (
    SELECT dp.conv_id, r.i, s0, s1, s2, {least('s3', insert('s2', 'assistant'))} AS s3, role, text, initial, gone, cut
    FROM (SELECT conv_id, i, s0, s1, {least('s2', *(insert(s, 'user') for s in ('s0', 's1', 's3')))} AS s2, s3 FROM dp) AS dp
    JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1)),
done AS (
  SELECT conv_id, {least('s0', least('s3', insert('s2', 'assistant')))} AS x
  FROM (SELECT conv_id, s0, {least('s2', *(insert(s, 'user') for s in ('s0', 's1', 's3')))} AS s2, s3, i, max(i) OVER (PARTITION BY conv_id) AS last FROM dp) WHERE i = last),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
         count(*) FILTER (WHERE cut > 0) AS truncated, count(*) FILTER (WHERE i > 1 AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, x.c AS cost, x.a AS audit, sha256(array_to_string(x.t, chr(10))) AS repaired_sha256
FROM done LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM done.conv_id"""



_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MATCHES = lambda pattern: f"len(regexp_extract_all(l, '{pattern}'))"
_SPACES = f"({_MATCHES(quality.SPACE + '+')} + 1)"
_LOW = f"translate(l, '{_UPPER}', '{_LOWER}')"
#: Whether a line breaks one of the rules.
_FAILS = f"""(regexp_matches(l, '[^\\x20\\x09-\\x0D]') AND (({_MATCHES('[.!?,;:…。]')} = 0 AND {_SPACES} >= 8) OR ({_MATCHES('!')} >= 4 AND 3 * {_MATCHES('!')} >= {_SPACES})
    OR ({_MATCHES('[#*$%&|<>]')} >= 2 AND 5 * {_MATCHES('[#*$%&|<>]')} >= {_SPACES})
    OR regexp_matches({_LOW}, '{quality.MENU.replace("'", "''")}') OR regexp_matches({_LOW}, '{quality.BOILERPLATE.replace("'", "''")}')))"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
win AS (SELECT rid, i, list_slice(w, i, i + 7) AS x FROM w, unnest(range(1, len(w) - 6)) AS u(i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, range(0, 8) AS r(k) GROUP BY rid),
x AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         list_filter(string_split(t, chr(10)), lambda l: {_FAILS}) AS bad, list_filter(string_split(t, chr(10)), lambda l: NOT {_FAILS}) AS good, lines
  FROM w LEFT JOIN rep USING (rid)),
y AS (SELECT *, CASE WHEN len(lines) > 0 THEN length(array_to_string(bad, ''))::DOUBLE / length(array_to_string(lines, ''))::DOUBLE ELSE 0 END AS lost FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.5 AS kept,
       len(bad)::BIGINT AS n_bad_lines, lost, sha256(array_to_string(good, chr(10))) AS cleaned_sha256
FROM y""",
    "op5_preference_chat": r"""
WITH t AS (
  SELECT conv_id, own, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rn
  FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations)),
p AS (
  SELECT *, max(rn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id, own) AS last_a,
         coalesce(lag(text) OVER (PARTITION BY conv_id, own ORDER BY rn), '') AS before
  FROM t),
q AS (
  SELECT *, coalesce(max(rn - 1) FILTER (WHERE rn = last_a AND text <> before) OVER (PARTITION BY conv_id, own), count(*) OVER (PARTITION BY conv_id, own)) AS n,
         CASE WHEN rn = last_a THEN before ELSE text END AS worse
  FROM p),
r AS (
  SELECT *, '<|' || role || '|>' || chr(10) AS head,
         '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS good,
         '<|' || role || '|>' || chr(10) || worse || chr(10) || '<|end|>' || chr(10) AS bad
  FROM q),
s AS (
  SELECT *, coalesce(sum(length(good)) FILTER (WHERE rn > n) OVER b, 0) - length(good) + length(head) AS good_at,
         coalesce(sum(length(bad)) FILTER (WHERE rn > n) OVER b, 0) - length(bad) + length(head) AS bad_at
  FROM r WINDOW b AS (PARTITION BY conv_id, own ORDER BY rn))
SELECT conv_id, max(n)::BIGINT AS n_prompt_turns,
       coalesce(string_agg(good, '' ORDER BY rn) FILTER (WHERE rn <= n), '') AS prompt,
       coalesce(string_agg(good, '' ORDER BY rn) FILTER (WHERE rn > n), '') AS chosen,
       coalesce(string_agg(bad, '' ORDER BY rn) FILTER (WHERE rn > n), '') AS rejected,
       coalesce(string_agg(good_at::BIGINT || ':' || (good_at + length(text))::BIGINT, ',' ORDER BY rn) FILTER (WHERE rn > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(bad_at::BIGINT || ':' || (bad_at + length(worse))::BIGINT, ',' ORDER BY rn) FILTER (WHERE rn > n AND role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY conv_id, own""",
    "op9_decontamination": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, m, list_slice(w, i, i + m - 1) AS x
  FROM (SELECT *, least(13, len(w)) AS m FROM b WHERE len(w) > 0), unnest(range(1, len(w) - m + 2)) AS u(i)),
dw AS (
  SELECT rid, i, m, list_slice(w, i, i + m - 1) AS x
  FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, greatest(1, len(w) - m + 2))) AS u(i)),
h AS (SELECT rid, i, dw.m, item_id FROM dw JOIN bw ON dw.x = bw.x AND dw.m = bw.m),
n AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT rid, i, m FROM h), unnest(range(0, m)) AS r(k) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, *,
         CASE WHEN CRC_OF_ID % 2 = 0
              THEN replace(text, chr(10), '') ELSE text END AS bad
  FROM documents),
e AS (
  SELECT rid, doc_id, source, sha256(ARRAY_HEAD || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(ARRAY_HEAD || coalesce(strlen(bad) || ':' || bad, '-')) AS bad_leaf
  FROM d),
up AS (
  SELECT source, 0 AS lvl, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, leaf AS h
  FROM e
  UNION ALL
  SELECT source, lvl + 1, i // 3, (n + 2) // 3, string_agg(h, '' ORDER BY i).sha256() FROM up WHERE n > 1 GROUP BY source, lvl, i // 3, n),
sub AS (SELECT source, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nr FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, nr AS i, (SELECT count(*) FROM sub) AS n, subroot AS h FROM sub
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, string_agg(h, '' ORDER BY i).sha256() FROM top WHERE n > 1 GROUP BY lvl, i // 3, n),
nodes AS (
  SELECT s.nr AS s, u.lvl, u.i, u.h, u.n FROM up u JOIN sub s ON u.source IS NOT DISTINCT FROM s.source WHERE u.n > 1
  UNION ALL
  SELECT NULL, lvl, i, h, n FROM top WHERE n > 1),
sib AS (
  SELECT a.s, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM nodes a JOIN nodes b ON a.s IS NOT DISTINCT FROM b.s AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 GROUP BY a.s, a.lvl, a.i),
leaves AS (
  SELECT e.*, s.nr, s.depth, s.subroot, row_number() OVER (PARTITION BY e.source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM e JOIN sub s ON e.source IS NOT DISTINCT FROM s.source),
steps AS (
  SELECT rid, lvl AS k, sib.l, sib.r FROM leaves JOIN sib ON sib.s = leaves.nr AND sib.i = leaves.i // (3 ** sib.lvl)::BIGINT
  UNION ALL
  SELECT rid, depth + lvl, sib.l, sib.r FROM leaves JOIN sib ON sib.s IS NULL AND sib.i = leaves.nr // (3 ** sib.lvl)::BIGINT),
way AS (SELECT rid, list({'l': l, 'r': r} ORDER BY k) AS p FROM steps GROUP BY rid),
fold AS (
  SELECT rid, 1 AS k, bad_leaf AS h FROM leaves
  UNION ALL
  SELECT fold.rid, k + 1, sha256(p[k].l || h || p[k].r) FROM fold JOIN way USING (rid) WHERE k <= len(p)),
got AS (SELECT rid, arg_max(h, k) AS h FROM fold GROUP BY rid)
SELECT doc_id, leaf, subroot, root.h AS root,
       sha256(coalesce(array_to_string(list_transform(p, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
       got.h AS folded_root, got.h = root.h AS verified
FROM (SELECT h FROM top WHERE n = 1) AS root, leaves JOIN got USING (rid) LEFT JOIN way USING (rid)""".replace("CRC_OF_ID", _CRC32("coalesce(doc_id::VARCHAR, '')")).replace("ARRAY_HEAD", " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in merkle.FIELDS[:-1])),
    "op12_conversation_repair": _repair_sql(),
}
