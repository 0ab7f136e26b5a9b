"""The registered queries of the training-data operators: each reads its whole table
and derives the contract's columns from its operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tyscope.llm import (
    alignment,
    collocation,
    decontaminate,
    fixity,
    html_main,
    mixing,
    preference,
    quality,
    sharding,
    simhash,
    substring,
    toxicity,
    url_rules,
)
from tyscope.session import read_table

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digest(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                       read_table(spark, sf_dir, "benchmark"))


def op4_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(docs).select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"))


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("_tox_score").alias("score"),
        (F.col("_tox_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages' WARC records against a replica in which three in a hundred pages
    are damaged: one byte changed, cut in half, or lost."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    record = fixity.warc_record()
    fate = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 4), 16, 10).cast("int") % 100
    replica = (F.when(fate == 7, F.concat(F.lit("X"), F.substring(record, F.lit(2), F.length(record))))
               .when(fate == 8, F.substring(record, F.lit(1), F.floor(F.length(record) / 2).cast("int")))
               .when(fate == 9, F.lit(None).cast("string")).otherwise(record))
    return fixity.audit(fixity.record_index(pages), fixity.record_index(pages, replica))


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as chosen, with its weakened form as rejected."""
    turns = preference.positions(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return preference.format_pairs(turns, preference.weakened(turns))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(read_table(spark, sf_dir, "documents").select("text", "lang"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the digest columns travel: the texts stay in the scan."""
    text = F.coalesce("text", F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shuffle(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_hg_shard").alias("shard"),
        F.col("_hg_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS pos FROM d),
grams AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER f AS g, count(*) OVER f AS n FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS k FROM grams WHERE n = 20) x
  WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 19)) AS pos FROM later),
kept AS (
  SELECT w.doc_id, count(gone.pos)::BIGINT AS n_removed,
         string_agg(word, ' ' ORDER BY w.pos) FILTER (gone.pos IS NULL) AS text
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.pos = gone.pos GROUP BY w.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP3_GRAMS = " UNION ALL ".join(
    f"""SELECT doc_id, pos, {n} AS n, g FROM (
    SELECT doc_id, pos, string_agg(word, ' ') OVER f AS g, count(*) OVER f AS have FROM w
    WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) x
  WHERE have = {n} AND EXISTS (SELECT 1 FROM b WHERE n = {n})""" for n in range(1, 11))

OP3_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
b AS (
  SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[s:s + least(10, len(words)) - 1], ' ') AS g
  FROM (SELECT item, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS s FROM items WHERE len(words) > 0) x),
w AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS pos FROM lowered),
grams AS (
  """ + _OP3_GRAMS + """),
hit AS (SELECT grams.doc_id, pos, b.n, item FROM grams JOIN b ON grams.n = b.n AND grams.g = b.g),
words_hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit
              FROM (SELECT doc_id, unnest(generate_series(pos, pos + n - 1)) AS p FROM hit) x GROUP BY doc_id),
items_hit AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, item FROM hit) x GROUP BY doc_id)
SELECT l.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""

OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, text)), 1, 8))::BIGINT AS k
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM sizes),
level AS (
  SELECT *, cap::DOUBLE / w AS q,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
           / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS lv
  FROM weighed
  WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least(cap::DOUBLE, (SELECT min_by(lv, q) FROM level WHERE q >= lv) * w) AS target FROM level),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
           lpad(length(bin(size))::VARCHAR, 2, '0') || rpad(substr(bin(size), 1, 5), 5, '0') DESC, k, doc_id) AS r
  FROM sized),
placed AS (
  SELECT ranked.*, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size::DOUBLE END AS rate,
         (('0x' || substr(md5('7|' || CASE WHEN ranked.source IS NULL THEN 'true' ELSE 'false' END || '|'
                              || coalesce(ranked.source, '')), 1, 5))::BIGINT::DOUBLE + 0.5) / 1048576::DOUBLE AS u
  FROM ranked JOIN targets t ON ranked.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(u + rate * r) - floor(u + rate * (r - 1))))::BIGINT AS taken
FROM placed
"""

OP10_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest),
rules(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT parts.page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM best
"""

OP8_SQL = r"""
WITH r AS (
  SELECT page_id, url,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
         || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
         || strlen(coalesce(html, ''))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
         || chr(13) || chr(10) || chr(13) || chr(10) AS record,
         ('0x' || substr(md5(page_id::VARCHAR), 1, 4))::BIGINT % 100 AS fate,
         ('0x' || substr(md5(concat_ws('|', page_id::VARCHAR, url)), 1, 8))::BIGINT AS k
  FROM pages),
f AS (SELECT *, k % (SELECT greatest(1, (sum(strlen(record)) + 67108863) // 67108864)::BIGINT FROM r) AS warc_file FROM r),
p AS (
  SELECT *, strlen(record)::BIGINT AS n_bytes, sha256(record) AS first_digest,
         coalesce(sum(strlen(record)) OVER (PARTITION BY warc_file ORDER BY page_id NULLS FIRST, sha256(record)
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS warc_offset
  FROM f)
SELECT page_id, warc_file, warc_offset, n_bytes, CASE WHEN fate = 9 THEN 'missing' ELSE 'altered' END AS status, first_digest,
       CASE fate WHEN 7 THEN sha256('X' || substr(record, 2)) WHEN 8 THEN sha256(left(record, length(record) // 2)) END
         AS second_digest
FROM p WHERE fate IN (7, 8, 9)
"""

OP9_SQL = r"""
WITH t AS (
  SELECT conv_id AS pair_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST)::INTEGER - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT *, max(pos) FILTER (role = 'assistant') OVER (PARTITION BY pair_id) AS last FROM t),
w AS (
  SELECT pair_id, pos, role, CASE WHEN pos = last THEN left(text, length(text) // 2) ELSE text END AS text
  FROM l WHERE last IS NULL OR pos <= last),
d AS (
  SELECT t.pair_id, coalesce(min(t.pos) FILTER (w.pos IS NULL OR w.text <> t.text), max(t.pos) + 1)::INTEGER AS prompt_turns
  FROM t LEFT JOIN w ON t.pair_id = w.pair_id AND t.pos = w.pos GROUP BY ALL),
parts AS (
  SELECT pair_id, prompt_turns, CASE WHEN pos < prompt_turns THEN 'prompt' ELSE 'chosen' END AS part, pos, role, text
  FROM t JOIN d USING (pair_id)
  UNION ALL
  SELECT pair_id, prompt_turns, 'rejected', pos, role, text FROM w JOIN d USING (pair_id) WHERE pos >= prompt_turns),
shown AS (SELECT *, '<|im_start|>' || role || chr(10) AS head, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s
          FROM parts),
placed AS (
  SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair_id, part ORDER BY pos
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM shown),
m AS (SELECT *, CASE WHEN role = 'assistant' THEN (begins + length(head))::VARCHAR || ':' || (begins + length(s))::VARCHAR END AS mask
      FROM placed)
SELECT pair_id, prompt_turns,
       coalesce(string_agg(s, '' ORDER BY pos) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(s, '' ORDER BY pos) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(s, '' ORDER BY pos) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg(mask, ',' ORDER BY pos) FILTER (part = 'chosen' AND mask IS NOT NULL), '') AS chosen_mask,
       coalesce(string_agg(mask, ',' ORDER BY pos) FILTER (part = 'rejected' AND mask IS NOT NULL), '') AS rejected_mask
FROM m GROUP BY pair_id, prompt_turns
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
sizes AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(words[s:s + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(generate_series(1, len(words) - k + 1)) AS s
        FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(words) >= k) x),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
inner_of AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(ws[1:2], ' ') AS phrase FROM cand WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(ws[2:3], ' ') FROM cand WHERE k = 3) x GROUP BY ALL),
kept AS (
  SELECT c.* FROM cand c LEFT JOIN inner_of i ON c.lang = i.lang AND c.phrase = i.phrase AND c.k = 2
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS p, array_to_string(ws[j + 1:], ' ') AS q
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM kept) x),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, l.a AS l, r.a AS r,
         ((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts c JOIN f l ON c.lang = l.lang AND c.p = l.phrase JOIN f r ON c.lang = r.lang AND c.q = r.phrase),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_html_main_text": op2_html_main_text,
    "op3_decontaminate": op3_decontaminate,
    "op4_isolation_forest": op4_isolation_forest,
    "op5_mix_sources": op5_mix_sources,
    "op6_simhash_golay": op6_simhash_golay,
    "op7_toxicity_nnpu": op7_toxicity_nnpu,
    "op8_merkle_audit": op8_merkle_audit,
    "op9_preference_pairs": op9_preference_pairs,
    "op10_url_rules": op10_url_rules,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_uniform_shards": op13_uniform_shards,
}
ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op3_decontaminate": OP3_SQL,
    "op5_mix_sources": OP5_SQL,
    "op8_merkle_audit": OP8_SQL,
    "op9_preference_pairs": OP9_SQL,
    "op10_url_rules": OP10_SQL,
    "op11_collocations": OP11_SQL,
}
