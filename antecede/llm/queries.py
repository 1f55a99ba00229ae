"""Registered queries of this subpackage, each with its SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from antecede.llm import conversations, language, line_runs, mixing, packing, posting_lists, secret_scan, spelling, suffix_dedup, templates, toxicity, warc
from antecede.llm.simhash import near_components
from antecede.llm.store import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op7_simhash")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    marked = near_components(table(spark, sf, "documents"), width=3, bound=3)
    return marked.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.col("component").alias("component_id"))


@query("op8_language")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language.fit(docs.where(~out))
    return language.predict(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        "lang_pred", "score")


@query("op9_toxicity")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("is_toxic"), F.min("quality").alias("is_good"))
    grades = labels.select("doc_id", toxicity.grade_of(F.col("is_toxic"), F.col("is_good")).alias("grade"))
    model = toxicity.fit(docs, grades, top=2)
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")


@query("op5_secret_scan")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf, "documents"), secret_scan.BASE + secret_scan.MORE)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = [r.kind for r in secret_scan.BASE]
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in base],
                        F.sha2(secret_scan.joined(F.col("spans"), base), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


@query("op6_line_dedup", """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key AS common FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON key = common GROUP BY doc_id""")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_runs.drop_common_lines(table(spark, sf, "documents"), min_docs=10, min_chars=1)
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_mix", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS DOUBLE) AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open,
             sum(source_size) OVER () AS total, row_number() OVER (ORDER BY cap / weight, source IS NULL, encode(source)) AS turn FROM w
      WINDOW before AS (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (CAST(total AS DOUBLE) * 1.5::DOUBLE - filled) / open AS level FROM f),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM v WHERE level * weight <= cap ORDER BY turn LIMIT 1) * weight, cap)) AS target FROM v),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t),
p AS (SELECT *, floor(rate)::BIGINT AS certain, rate - floor(rate) AS part FROM r),
u AS (SELECT d.*, source_size, target, certain, part,
             (CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
             CASE WHEN size < 4 THEN size ELSE length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)::INT) END AS stratum
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
o AS (SELECT *, CASE WHEN part > 0 AND size > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS odds FROM u),
g AS (SELECT source, stratum, count(*) AS n, sum(size)::BIGINT AS words, first(part) AS part,
             row_number() OVER (PARTITION BY source ORDER BY stratum DESC) AS k FROM o WHERE odds IS NOT NULL GROUP BY source, stratum),
serve AS (
  SELECT source, stratum, k, least(greatest(floor(words * part / (words / n) + 0.5), 0), n)::BIGINT AS take,
         words * part - least(greatest(floor(words * part / (words / n) + 0.5), 0), n)::BIGINT * (words / n) AS owed FROM g WHERE k = 1
  UNION ALL
  SELECT g.source, g.stratum, g.k, least(greatest(floor((owed + words * part) / (words / n) + 0.5), 0), n)::BIGINT,
         owed + words * part - least(greatest(floor((owed + words * part) / (words / n) + 0.5), 0), n)::BIGINT * (words / n)
  FROM serve JOIN g ON g.source IS NOT DISTINCT FROM serve.source AND g.k = serve.k + 1),
q AS (SELECT o.*, take, row_number() OVER (PARTITION BY o.source, o.stratum, odds IS NULL ORDER BY odds, doc_id, size) AS rank
      FROM o LEFT JOIN serve ON o.source IS NOT DISTINCT FROM serve.source AND o.stratum = serve.stratum)
SELECT doc_id, size, source_size, target, size * (certain + CASE WHEN odds IS NOT NULL AND rank <= take THEN 1 ELSE 0 END)::BIGINT AS taken FROM q""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op1_warc_bundles")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    index, folder = warc.bundle(table(spark, sf, "pages"))
    return warc.read_records(index, folder).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_posting_lists")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return posting_lists.nearest(table(spark, sf, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20)


@query("op3_template_leaks")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = templates.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), width=5, similarity=0.8)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "changed")


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffix_dedup.repeated_strings(table(spark, sf, "documents"), length=100)
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_pack")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: CRC-32 of a string in DuckDB, which has no such function: one byte at a time through the table of its 256 remainders.
CRC_SQL = """
crc_steps AS MATERIALIZED (
  SELECT list(r ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r
    FROM (SELECT unnest(range(256))::BIGINT AS i)))"""


def crc_sql(text: str) -> str:
    """SQL of the CRC-32 of the string ``text``; the query names ``crc_steps``."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), "
            f"lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295)")


@query("op13_spelling", f"""
WITH RECURSIVE {CRC_SQL},
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM r WHERE length(run) >= 5 GROUP BY 1, 2),
h AS (SELECT run, k, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM l, crc_steps),
d AS (SELECT k, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
c AS (SELECT word, n, length(word) AS size, unnest(range(length(word))) AS i FROM w),
x AS MATERIALIZED (SELECT word, n, size, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM c),
e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.size = b.size AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.rest = w.word
      UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.rest = w.word),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n FROM e GROUP BY word),
t AS (SELECT e.word, min(near) AS best FROM e JOIN b ON e.word = b.word AND near_n = best_n GROUP BY e.word),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
      FROM w LEFT JOIN b ON w.word = b.word LEFT JOIN t ON w.word = t.word),
s AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form FROM s JOIN f ON s.at = f.word WHERE f.form IS NOT NULL),
z AS (SELECT s.word, s.at AS root FROM s JOIN f ON s.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN z ON f.word = z.word""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling.vocabulary(spelling.damaged_words(table(spark, sf, "documents")), least=3)
    return spelling.variants(words, times=2)


@query("op11_conversation_repair", f"""
WITH RECURSIVE {CRC_SQL},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc_steps),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM o WHERE kind <> 0),
p AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
f AS MATERIALIZED (SELECT conv_id, i, turn, role, text, initial, bare = '' AS blank, bare <> '' AND seen > 1 AS again,
             bare <> '' AND seen = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM p),
n AS MATERIALIZED (SELECT conv_id, count(*) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS again, count(*) FILTER (cut) AS cut,
             count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
             coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
b AS (
  SELECT conv_id, n + 1 AS i, 0::BIGINT AS v0, 6::BIGINT AS v1, 3::BIGINT AS v2, 0::BIGINT AS v3 FROM n
  UNION ALL
  SELECT conv_id, i, least(c0, 3 + least(c2, 3 + c3)), least(c1, 3 + least(c2, 3 + c3)), least(c2, 3 + c3), least(c3, 3 + c2) FROM (
    SELECT f.conv_id, f.i, least(4 + v0, t + CASE initial WHEN 's' THEN v1 WHEN 'u' THEN v2 ELSE 3 + v2 END, t + 3 + v2) AS c0,
           least(4 + v1, t + CASE initial WHEN 'u' THEN v2 ELSE 3 + v2 END) AS c1, least(4 + v2, t + CASE initial WHEN 'a' THEN v3 ELSE 3 + v3 END) AS c2,
           least(4 + v3, t + CASE initial WHEN 'u' THEN v2 ELSE 3 + v2 END) AS c3
    FROM b JOIN (SELECT *, CASE WHEN blank OR again THEN 1000000000 WHEN cut THEN 3 ELSE 0 END AS t FROM f) f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)),
v AS MATERIALIZED (SELECT b.*, f.role, f.text, initial, CASE WHEN blank OR again THEN 1000000000 WHEN cut THEN 3 ELSE 0 END AS t, lead([v0, v1, v2, v3]) OVER (PARTITION BY b.conv_id ORDER BY b.i) AS after, [v0, v1, v2, v3] AS now
      FROM b LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i),
g AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS q, '' AS audit, NULL::VARCHAR AS line, 0 AS k FROM n
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE WHEN edit = 'D' THEN q WHEN edit = 'K' AND initial = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END, edit,
         CASE edit WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text ELSE CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN edit = 'I' THEN '' ELSE text END END, k + 1
  FROM (SELECT g.conv_id, g.i, g.q, g.k, role, text, initial,
               CASE WHEN after IS NULL THEN CASE WHEN q IN (1, 2) THEN 'I' END
                    WHEN 4 + after[q + 1] = now[q + 1] THEN 'D'
                    WHEN 3 + now[CASE WHEN q = 2 THEN 4 ELSE 3 END] = now[q + 1] THEN 'I'
                    WHEN t + CASE WHEN q = 0 AND initial = 's' THEN after[2] WHEN q = 2 AND initial = 'a' THEN after[4] WHEN q <> 2 AND initial = 'u' THEN after[3] END = now[q + 1] THEN 'K'
                    ELSE 'R' END AS edit
        FROM g JOIN v ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i) WHERE edit IS NOT NULL),
a AS (SELECT conv_id, string_agg(audit, '' ORDER BY k) AS audit, string_agg(line, chr(10) ORDER BY k) FILTER (line IS NOT NULL) AS lines FROM g GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(again, 0)::BIGINT AS duplicate, coalesce(cut, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.v0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
     LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 1 LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    fixed = conversations.repair(conversations.damage(rows), rows.select("conv_id"))
    return fixed.select(F.col("id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
