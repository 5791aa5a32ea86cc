"""The registered queries of these operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.llm import ann, lexical, licenses, lm_scoring, mixing, near_dedup, packing, passages, periodic, quality_model, quality_rules, quotations, toxicity
from quarrystat.llm.common import crc_remainder, documents, let, text_or_empty, words_of

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def judged(scored: DataFrame, held_out: Column, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir).select("doc_id", "text"), crc_remainder("doc_id", 3) == 1
    model = quality_model.fit(docs, labels(spark, sf_dir), fits=~held_out)
    return judged(quality_model.score(docs, model), held_out, 0.5)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lm_scoring.score(docs, crc_remainder("doc_id", 10) == 0)


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no quotes, so its messages first get them, as replies by mail have."""
    return quotations.link(quotations.quoting(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL3 = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM MESSAGES),
l AS (SELECT conv_id, turn, role, i, ls[i] AS line, regexp_matches(ls[i], '^[ \t]*>') AS quoted, coalesce(regexp_matches(ls[i + 1], '^[ \t]*>'), false) AS before,
  regexp_replace(ls[i], '^[ \t]*>([ \t]*>)*', '') AS body FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM m)),
k AS (SELECT *, nullif(trim(regexp_replace(lower(body), '[\x20\x09-\x0D]+', ' ', 'g')), '') AS key, len(line) - len(body) AS marks,
  CASE WHEN quoted THEN len(regexp_replace(regexp_extract(line, '^[ \t]*>([ \t]*>)*'), '[^>]', '', 'g')) ELSE 0 END AS level,
  NOT quoted AND NOT (before AND regexp_matches(line, '(?i)^[ \t]*(on\b.*\bwrote|.*\bsaid)[ \t]*:[ \t]*$')) AS own FROM l),
w AS (SELECT conv_id, key, min(turn) AS first FROM k WHERE own AND key IS NOT NULL GROUP BY conv_id, key),
x AS (SELECT q.conv_id, q.turn, q.i, q.level, first FROM k q JOIN w ON q.conv_id = w.conv_id AND q.key = w.key AND first < q.turn WHERE level > 0),
qw AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i, p) AS pos FROM (SELECT conv_id, turn, level, i, len(string_split(key, ' ')) AS m, unnest(string_split(key, ' ')) AS x, generate_subscripts(string_split(key, ' '), 1) AS p FROM k WHERE level > 0 AND key IS NOT NULL)),
qr AS (SELECT conv_id, turn, level, pos, concat_ws(' ', x, lead(x, 1) OVER v, lead(x, 2) OVER v, lead(x, 3) OVER v, lead(x, 4) OVER v) AS run, lead(x, 4) OVER v AS last FROM qw WINDOW v AS (PARTITION BY conv_id, turn, level ORDER BY pos)),
ow AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, p) AS pos FROM (SELECT conv_id, turn, i, unnest(string_split(key, ' ')) AS x, generate_subscripts(string_split(key, ' '), 1) AS p FROM k WHERE own AND key IS NOT NULL)),
orun AS (SELECT conv_id, turn, concat_ws(' ', x, lead(x, 1) OVER v, lead(x, 2) OVER v, lead(x, 3) OVER v, lead(x, 4) OVER v) AS run, lead(x, 4) OVER v AS last FROM ow WINDOW v AS (PARTITION BY conv_id, turn ORDER BY pos)),
wr AS (SELECT conv_id, run, min(turn) AS first FROM orun WHERE last IS NOT NULL GROUP BY ALL),
hit AS (SELECT conv_id, qr.turn, level, unnest(range(pos, pos + 5)) AS pos, first FROM qr JOIN wr USING (conv_id, run) WHERE last IS NOT NULL AND first < qr.turn),
share AS (SELECT conv_id, turn, level, i, first, count(DISTINCT pos) AS n FROM hit JOIN qw USING (conv_id, turn, level, pos) GROUP BY ALL HAVING 2 * count(DISTINCT pos) >= max(m)),
y AS (SELECT conv_id, turn, i, level, first FROM share ANTI JOIN x USING (conv_id, turn, i) QUALIFY row_number() OVER (PARTITION BY conv_id, turn, i ORDER BY n DESC, first DESC) = 1),
t AS (SELECT conv_id, turn, first, min(level) AS level, count(*) AS n FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY ALL),
f AS (SELECT conv_id, turn, arg_max(first, (-level, n, first)) AS parent, sum(n) AS n_linked FROM t GROUP BY conv_id, turn),
p(conv_id, turn, root, depth) AS (
  SELECT conv_id, turn, turn, 0 FROM m ANTI JOIN f USING (conv_id, turn)
  UNION ALL SELECT f.conv_id, f.turn, p.root, p.depth + 1 FROM p JOIN f ON f.conv_id = p.conv_id AND f.parent = p.turn),
o AS (SELECT conv_id, turn, role, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (own), ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS text,
  count(*) FILTER (level > 0 AND key IS NOT NULL) AS n_quoted FROM k GROUP BY conv_id, turn, role)
SELECT conv_id, turn, role, text, n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, parent, root, CAST(depth AS BIGINT) AS depth
FROM o LEFT JOIN f USING (conv_id, turn) JOIN p USING (conv_id, turn)"""

#: The same messages with the quotes that quotations.quoting gives them.
QUOTING = r"""(
  WITH s AS (SELECT *, string_split(trim(regexp_replace(said, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY ALL HAVING said <> ''))
  SELECT c.conv_id, c.turn, c.role,
    coalesce('> > ' || replace(b.said, chr(10), chr(10) || '> > ') || chr(10), '') || coalesce('> ' || replace(CASE WHEN c.turn % 3 = 1 AND len(a.w) >= 8 THEN array_to_string(list_transform(range(3, len(a.w) + 1, 9), lambda i: array_to_string(a.w[i : i + 8], ' ')), chr(10)) ELSE a.said END, chr(10), chr(10) || '> ') || chr(10), '') || coalesce(c.text, '') AS text
  FROM conversations c LEFT JOIN s a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 AND c.turn % 3 <> 0 LEFT JOIN s b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2 AND c.turn % 3 = 2)"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def sql5() -> str:
    """Containment by counting, without the filters: of lines, and of runs of words in texts of several lines."""
    between = licenses.BETWEEN
    values = ", ".join(f"('{label}', {[*dict.fromkeys(t.split())]}, {len(t.split())})" for label, texts in licenses.TEMPLATES.items() for t in texts)
    phrases = ", ".join(f"('{label}', {p.split()})" for p, label in licenses.PHRASES.items())
    return rf"""
    WITH docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    words AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{between}'), lambda w: w <> '') AS w FROM docs),
    phrases(label, p) AS (VALUES {phrases}),
    following AS (SELECT doc_id, i - 1 AS place, [x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o] AS f
      FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    places AS (SELECT doc_id, label, place FROM following, phrases WHERE f[1 : len(p)] = p),
    base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
    templates(label, tokens, words) AS (VALUES {values}),
    lines AS (SELECT doc_id, list_distinct(regexp_split_to_array(unnest(string_split(t, chr(10))), '{between}')) AS l FROM docs),
    held AS (SELECT doc_id, label, len(list_intersect(l, tokens)) / len(tokens) AS share FROM lines, templates WHERE len(list_intersect(l, tokens)) >= ceil(0.8 * len(tokens) - 1e-9)),
    hits AS (SELECT doc_id, label, tokens, words, x, i FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words WHERE contains(t, chr(10))), templates WHERE list_contains(tokens, x)),
    runs AS (SELECT a.doc_id, a.label, count(DISTINCT b.x) / len(a.tokens) AS share FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.tokens = b.tokens AND b.i BETWEEN a.i AND a.i + a.words - 1
      GROUP BY a.doc_id, a.label, a.tokens, a.i HAVING count(DISTINCT b.x) >= ceil(0.8 * len(a.tokens) - 1e-9)),
    all_labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM (SELECT * FROM held UNION ALL SELECT * FROM runs UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(share, 0) AS DOUBLE) AS score
    FROM words LEFT JOIN base USING (doc_id) LEFT JOIN all_labels USING (doc_id)"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


SQL6 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5('0:' || CAST(doc_id AS VARCHAR)) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
t AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS turn FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY turn, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY turn, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t),
aims AS (SELECT source, source_size, round(least(cap, w * max(CASE WHEN level <= turn THEN level END) OVER ()), 6) AS target FROM l),
sent AS (SELECT doc_id, source, size, place, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS sent FROM d),
queue AS (SELECT doc_id, s.source, size, source_size, target, place, copy, CASE WHEN target > 0 THEN CAST(sent + copy * source_size AS DOUBLE) / target ELSE 0 END AS time
  FROM sent s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source, (VALUES (0), (1)) c(copy)),
cut AS (SELECT *, sum(size) OVER (ORDER BY time, source NULLS LAST, place, doc_id, copy ROWS UNBOUNDED PRECEDING) - size / 2 <= 1.5 * (SELECT sum(size) FROM d) AS taken FROM queue)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * count(*) FILTER (taken) AS BIGINT) AS taken FROM cut GROUP BY doc_id, source, size, source_size, target, place"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text"))
    measures = quality_rules.MEASURES
    return rows.select("doc_id", *measures[:5], "base_failed", "kept", *measures[5:], "fail_bits")


def sql7() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality_rules.RULES))
    return rf"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
    lines AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM docs),
    windows AS (SELECT doc_id, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS win
      FROM (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM docs) WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY i <= n - 4),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
    covered AS (SELECT doc_id, sum(step) AS n FROM (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS step FROM twice) GROUP BY doc_id),
    m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(w, lambda x: regexp_matches(x, '{quality_rules.LETTER}'))) AS BIGINT) AS n_letter_words,
      CAST(len(list_filter(l, lambda x: regexp_matches(x, '{quality_rules.BULLET}'))) AS BIGINT) AS n_bullet_lines, CAST(len(list_filter(l, lambda x: regexp_matches(x, '{quality_rules.OPEN}'))) AS BIGINT) AS n_open_lines
      FROM lines LEFT JOIN covered USING (doc_id)),
    b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
    SELECT *, fail_bits & {quality_rules.mask("base")} <> 0 AS base_failed, fail_bits & {quality_rules.mask("base") | quality_rules.mask("v1")} = 0 AS kept FROM b"""


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


SQL8 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir).select("doc_id", "text"), crc_remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, labels(spark, sf_dir), fits=~held_out)
    return judged(toxicity.score(docs, model), held_out, 0.3)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every item's score for every document that holds a term of it.
SQL11 = r"""
WITH folded AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
asked AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> ''))) AS term FROM benchmark),
corpus AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS words FROM folded),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM folded) SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), corpus),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), corpus GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50"""


def periodic_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten, by its id, goes on with a period from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    g = F.floor(h / 10)

    def altered(words: Column) -> Column:
        n = F.size(words)
        parts = F.struct(n.alias("n"), (g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"))
        at = lambda x, i: F.when(i < x.a, i).otherwise(x.a + (i - x.a) % x.p)
        return let(parts, lambda x: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, at(x, i).cast("int"))), " "))

    words = words_of(text_or_empty())
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), let(words, altered)).otherwise(text_or_empty()).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.collapse(periodic_texts(documents(spark, sf_dir).select("doc_id", "text")))
    better = lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best)
    line = lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    best = F.reduce("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)
    return rows.withColumn("best", best).select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Every pair of equal words of a text, gathered to stretches of one distance; crc32 bit by bit.
SQL12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) AS h FROM documents),
g AS (SELECT *, len(w)::BIGINT AS n, (h // 10)::BIGINT AS g FROM d),
p AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
words AS (SELECT r, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM t),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.r = b.r AND a.x = b.x AND a.i < b.i AND 3 * (b.i - a.i) <= a.n),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS grp FROM pairs) GROUP BY r, q, grp HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DECIMAL(18, 0) / period DESC, start, period) = 1),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


#: Every window of 35 words as a string.
SQL13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS run FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT r, i FROM starts SEMI JOIN (SELECT run FROM starts GROUP BY run HAVING count(*) > 1) USING (run)),
covered AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM twice),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS text FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_quotation_linking": op3_quotation_linking,
        "op4_near_dedup": op4_near_dedup,
        "op5_license_scan": op5_license_scan,
        "op6_mixing": op6_mixing,
        "op7_quality_rules": op7_quality_rules,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_packing": op9_packing,
        "op10_toxicity": op10_toxicity,
        "op11_lexical_search": op11_lexical_search,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_substring_dedup": op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quotation_linking": SQL3.replace("MESSAGES", QUOTING), "op5_license_scan": sql5(), "op6_mixing": SQL6, "op7_quality_rules": sql7(), "op8_nearest_neighbours": SQL8, "op11_lexical_search": SQL11, "op12_periodic_runs": SQL12, "op13_substring_dedup": SQL13}
