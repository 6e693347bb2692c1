"""The thin contract queries of the numbered operators and, where SQL expresses them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm import audit, chat, html, licenses, suffix, warc, whitening
from cotejo.llm.decontam import contamination
from cotejo.llm.exact import exact_copies
from cotejo.llm.neardup import near_duplicates
from cotejo.llm.packing import pack
from cotejo.llm.quality import MEASURES, judge
from cotejo.llm.substring import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH fold AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM fold),
item AS (SELECT DISTINCT id AS item_id, least(10, len(ws)) AS k, array_to_string(ws[a:a + least(10, len(ws)) - 1], ' ') AS g
         FROM (SELECT id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS a FROM w WHERE kind = 'i' AND len(ws) > 0)),
doc AS (SELECT id AS doc_id, a, k, array_to_string(ws[a:a + k - 1], ' ') AS g
        FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS a FROM w, (SELECT DISTINCT k FROM item) WHERE kind = 'd' AND len(ws) >= k)),
hit AS (SELECT doc_id, a, k, item_id FROM doc JOIN item USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + k)) AS j FROM (SELECT DISTINCT doc_id, a, k FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n ON n.doc_id = w.id LEFT JOIN it ON it.doc_id = w.id WHERE kind = 'd'
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(_table(spark, sf_dir, "pages"))
    page = lambda urn: F.regexp_extract(urn, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    records = warc.read(files).where("record_type <> 'gap'")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP3_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
bits AS (SELECT page_id, n, x, array_to_string(list_transform(string_split(x, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS s FROM h),
d AS (SELECT page_id, n, x, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
             + 16 * CAST(substr(s, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(s, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(s, 5 * i + 3, 1) AS INTEGER)
             + 2 * CAST(substr(s, 5 * i + 4, 1) AS INTEGER) + CAST(substr(s, 5 * i + 5, 1) AS INTEGER), 1)), '') AS code, min(page_id) OVER (PARTITION BY x) AS first FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, code AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM d
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", *MEASURES, "base_failed", "kept")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
line AS (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
dup AS (SELECT doc_id, sum(c - 1) AS n_dup FROM line GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_rep FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
f AS (SELECT *, (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words) AS failed FROM b),
h AS (SELECT source AS host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(failed AS INTEGER)) AS DOUBLE) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS s FROM p),
r AS (SELECT host, (bad + m * s) / (n + s) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND CASE WHEN rate > 0.5 THEN false WHEN rate < 0.05 THEN true ELSE NOT failed END) AS kept
FROM f LEFT JOIN r ON host = source
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.by_document(_table(spark, sf_dir, "documents"), licenses.default_templates(spark))
    return found.select("doc_id", F.size("templates").cast("long").alias("n_templates"), F.array_join("templates", ",").alias("templates"))


def _op6_sql() -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.TEMPLATES)
    return rf"""
WITH t(template, text) AS (VALUES {values}),
x AS (SELECT doc_id, NULL AS template, text FROM documents UNION ALL SELECT NULL, template, text FROM t),
w AS (SELECT doc_id, template, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x),
s AS (SELECT DISTINCT doc_id, template, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
n AS (SELECT template, count(*) AS n FROM s WHERE template IS NOT NULL GROUP BY template),
f AS (SELECT d.doc_id, p.template, count(*) AS c FROM s d JOIN s p ON d.g = p.g WHERE d.doc_id IS NOT NULL AND p.template IS NOT NULL GROUP BY d.doc_id, p.template),
g AS (SELECT doc_id, count(*) AS n_templates, string_agg(f.template, ',' ORDER BY f.template) AS templates FROM f JOIN n ON n.template = f.template WHERE 100 * c >= 80 * n GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_templates, 0) AS n_templates, coalesce(templates, '') AS templates FROM documents LEFT JOIN g USING (doc_id)
"""


def op7_chat_format(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    own = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(*chat.chat_format(turns, tokenizer), tokenizer)


OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(9 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*/?s>')) + len(regexp_extract_all(role, '<\\*/?s>'))
                + len(regexp_extract_all(role, '[\\\n]'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
edge AS (SELECT doc_id, i, coalesce(i > max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50, true) AS new FROM hit),
run AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
keep AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM span
         UNION ALL SELECT span.doc_id, max(span.b), any_value(n) FROM span JOIN d USING (doc_id) GROUP BY span.doc_id),
t AS (SELECT keep.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM keep JOIN d USING (doc_id) GROUP BY keep.doc_id),
s AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS gone FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def op10_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = pack(_table(spark, sf_dir, "documents"), tokenizer)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM hit),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM d),
kept AS (SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.j) AS t, count(*) AS n
         FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.j = gone.j GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return audit.audit(docs, _table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
b AS (SELECT d.doc_id, part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
             + CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > first THEN 16 ELSE 0 END AS failed FROM d JOIN e USING (t)),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY part, failed),
f AS (SELECT unnest(range(0, 5)) AS i),
o AS (SELECT [v.i, w.i, x.i, y.i, z.i] AS o FROM f v, f w, f x, f y, f z WHERE len(list_distinct([v.i, w.i, x.i, y.i, z.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', CAST(i AS INTEGER) + 1, 1)), '') AS filter_order, CAST(k AS INTEGER) AS step, CAST(1 << o[k] AS INTEGER) AS own,
             CAST(coalesce(list_sum(list_transform(o[1:k - 1], lambda i: 1 << i)), 0) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE failed & (before | own) = 0) AS kept, sum(n) FILTER (WHERE failed & before = 0 AND failed & own <> 0) AS removed,
             sum(n) FILTER (WHERE failed & before <> 0 AND failed & own <> 0) AS redundant, sum(n) FILTER (WHERE failed = own) AS unique_fails,
             sum(good) FILTER (WHERE failed & before = 0 AND failed & own <> 0) AS good_lost, sum(toxic) FILTER (WHERE failed & before = 0 AND failed & own <> 0) AS toxic_lost FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_copies(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_dedup": op2_near_dedup,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extraction": op5_html_extraction,
    "op6_license_scan": op6_license_scan,
    "op7_chat_format": op7_chat_format,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_near_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op4_quality_rules": OP4_SQL, "op6_license_scan": _op6_sql(), "op7_chat_format": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op9_suffix_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_exact_dedup": OP12_SQL}
