"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.llm import chat, exact, jaccard, langid, lines, mixing, packing, quality, repair, resample, sharding, substring, suffix
from spreadlab.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         CAST(source_size * 3 AS DOUBLE) AS full_size FROM by_source
), reached AS (SELECT *, full_size / w AS reach FROM weighed
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM by_source) - coalesce(sum(full_size) OVER b, 0)) / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER b, 0)) AS lev
  FROM reached WINDOW b AS (ORDER BY reach, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least((SELECT max(lev) FROM levels WHERE lev <= reach) * w, full_size) AS target,
         CAST(CAST('0x' || substr(md5('mix-1|offset|' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift
  FROM levels
), ranked AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.shift, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY length(bin(s.size)) * 16 + (s.size >> greatest(length(bin(s.size)) - 4, 0)), h, s.size, s.doc_id) AS r
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), counted AS (SELECT *, CAST(floor(r * rate + shift) - floor((r - 1) * rate + shift) AS INTEGER) AS copies FROM ranked)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM counted"""


@query("op1_mixing", MIXING_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, CAST(n_chars AS BIGINT) AS n_chars FROM k"""


@query("op3_exact_dedup", EXACT_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.content_sort(table(spark, sf_dir, "documents"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


STOP_SQL = ", ".join(f"'{w}'" for w in sorted({*quality.STOP_WORDS, *(w.capitalize() for w in quality.STOP_WORDS)}))
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(w, lambda x: rtrim(x, '.,;:') IN ({STOP_SQL}))) AS BIGINT) AS n_stop_words,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id
), v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * word_chars >= 200 * n_words AND 100 * word_chars <= 2000 * n_words AND 100 * n_symbols <= 10 * n_words
       AND 100 * n_stop_words >= 2 * n_words AND 100 * n_dup_lines <= 50 * n_lines AS kept FROM v"""


@query("op8_quality_rules", QUALITY_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_rules(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def sql_escaped(column: str) -> str:
    out = f"replace({column}, chr(27), chr(27) || '0')"
    for control, code in zip(chat.CONTROLS, chat.CODES):
        out = f"replace({out}, '{control}', chr(27) || '{code[1]}')"
    return out


CHAT_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length({sql_escaped('text')}) AS t, length({sql_escaped('role')}) AS r,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens FROM rows_
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(t + CASE WHEN opens THEN {len(chat.START) + len(chat.SAY) + len(chat.END)} + r ELSE {len(chat.MORE)} END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op9_chat_formatting", CHAT_SQL)
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.read_chats(chat.format_chats(rows.unionByName(extra)))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
p AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM r),
k AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d) ANTI JOIN p USING (doc_id, p)),
s AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.t, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""


@query("op2_substring_dedup", SUBSTRING_SQL)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_passages(table(spark, sf_dir, "documents")).drop("removed_spans")


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = d.doc_id"""


@query("op10_ngram_jaccard", JACCARD_SQL)
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_sets(table(spark, sf_dir, "documents"))


#: The whole strings are compared: no SQL gives all positions of all texts in bearable time. tests/llm holds it against brute force.
@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeats(table(spark, sf_dir, "documents")).drop("removed_spans")


LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, place, line, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i
      FROM (SELECT doc_id, unnest(generate_series(1, len(s))) AS place, unnest(s) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, i, md5(line) || md5(lead(line) OVER (PARTITION BY doc_id ORDER BY i)) AS k FROM l),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w WHERE k IS NOT NULL) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM r UNION ALL SELECT doc_id, i + 1 FROM r)),
a AS (SELECT doc_id, unnest(generate_series(1, len(s))) AS place, unnest(s) AS line FROM d),
k AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.place) AS t
      FROM a LEFT JOIN l ON a.doc_id = l.doc_id AND a.place = l.place LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY a.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id), m AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)"""


@query("op7_line_dedup", LINES_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: Every line that occurs earlier goes, whatever stands around it; op7_line_dedup takes runs of two.
SINGLE_LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
a AS (SELECT doc_id, unnest(generate_series(1, len(s))) AS place, unnest(s) AS line FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS n FROM a WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (n > 1) AS n_removed FROM l GROUP BY doc_id),
k AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.place) AS t FROM a LEFT JOIN l USING (doc_id, place) WHERE l.n IS NULL OR l.n = 1 GROUP BY a.doc_id)
SELECT d.doc_id, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""


@query("op7_single_line_dedup", SINGLE_LINES_SQL)
def op7_single_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, sf_dir, "documents"), run=1)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: No SQL moves documents turn by turn under quotas; tests/llm holds the result against its law.
@query("op11_sharding")
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


#: Cheapest edits need a recursion over rows and states; tests/llm holds them against all edits of short conversations.
@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), gone="gone")


FEATURES_SQL = """SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"""
RESAMPLE_SQL = f"""
WITH d AS ({FEATURES_SQL.format(id='doc_id', table='documents')}), b AS ({FEATURES_SQL.format(id='item_id', table='benchmark')}),
f AS (SELECT id, list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
e AS (SELECT list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
fc AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(f) AS g FROM f) GROUP BY id, g),
ec AS (SELECT g, count(*) AS n FROM (SELECT unnest(f) AS g FROM e) GROUP BY g),
x AS (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM fc UNION SELECT g FROM ec)),
t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
k AS (SELECT g, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
             lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8))) % 10000 AS k FROM x, t),
s AS (SELECT k, sum(n) AS n FROM fc JOIN k USING (g) GROUP BY k), u AS (SELECT k, sum(n) AS n FROM ec JOIN k USING (g) GROUP BY k),
z AS (SELECT k, CAST(floor(1000 * ln(CAST(coalesce(u.n, 0) + 1 AS DOUBLE) * ((SELECT sum(n) FROM s) + 10000) / (CAST(s.n + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM u) + 10000)))) AS BIGINT) AS gain
      FROM s LEFT JOIN u USING (k)),
m AS (SELECT id, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM fc JOIN k USING (g) JOIN z USING (k) GROUP BY id),
r AS (SELECT d.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(greatest(2 * len(w) - 1, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || CAST(d.id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN m ON m.id = d.id),
q AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS p, count(*) OVER (PARTITION BY n_words >= 20) AS c FROM r)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND p <= 25 * c // 100 THEN p END AS rank FROM q"""


@query("op13_importance_resampling", RESAMPLE_SQL)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
