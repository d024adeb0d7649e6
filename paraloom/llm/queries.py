"""The queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.llm import boilerplate, distinctive, language, leaks, near_duplicates, personal, scan_noise, term_counts, text_quality, tokenize
from paraloom.llm.words import ALL_FUNCTION_WORDS
from paraloom.session import fresh_path, materialize
from paraloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
PARAGRAPHS = "processed_paragraphs_filtered"


# Problem 1 ------------------------------------------------------------------

def _scan_signs(spark: SparkSession, folder: str):
    paragraphs = table(spark, folder, PARAGRAPHS, "para_id", "filename", "text")
    model = scan_noise.fit(paragraphs)
    found = materialize(scan_noise.signs(paragraphs, model), "scan-signs")
    titles = scan_noise.headers(found, table(spark, folder, "source_files", "filename", "title"), paragraphs)
    return paragraphs, model, found, titles


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    _, _, found, titles = _scan_signs(spark, folder)
    plain = found.where("kind <> 'maybe_header'").select("para_id", "kind")
    return plain.unionByName(titles.select("para_id", F.lit("header").alias("kind")).distinct())


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    paragraphs, model, _, titles = _scan_signs(spark, folder)
    return scan_noise.repaired(paragraphs, model, titles)


# Problem 2 ------------------------------------------------------------------

def p2_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality.text_statistics(table(spark, folder, PARAGRAPHS, "para_id", "text"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_statistics(spark, folder).where(F.col("kind").isin("list", "table", "junk")).select("para_id", "kind")


_SHARES = "n_chars n_words mean_word_length symbol_ratio digit_ratio common_share punctuated_lines n_lines".split()


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics that are counts and shares, which SQL can tell too."""
    return p2_statistics(spark, folder).select("para_id", *[F.round(c, 9).alias(c) if c.endswith(("length", "ratio", "share", "lines")) and not c.startswith("n_") else F.col(c) for c in _SHARES])


_BLANK = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
P2_SHARES = rf"""
WITH t AS (SELECT para_id, coalesce(text, '') AS text, regexp_extract_all(text, '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS w,
  list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda x: NOT regexp_full_match(x, '{_BLANK}*')) AS lines,
  coalesce(regexp_full_match(text, '{_BLANK}*'), true) AS blank FROM processed_paragraphs_filtered),
s AS (SELECT *, length(text) AS n, list_sum(list_transform(w, lambda x: length(x))) AS letters, length(text) - length(regexp_replace(text, '{_BLANK}', '', 'g')) AS spaces,
  length(text) - length(regexp_replace(text, '\p{{Nd}}', '', 'g')) AS digits FROM t)
SELECT para_id, n AS n_chars, CASE WHEN blank THEN 0 ELSE len(w) END AS n_words, CASE WHEN blank OR len(w) = 0 THEN 0 ELSE round(letters / len(w)::DOUBLE, 9) END::DOUBLE AS mean_word_length,
  CASE WHEN blank THEN 0 ELSE round((n - coalesce(letters, 0) - digits - spaces) / n::DOUBLE, 9) END::DOUBLE AS symbol_ratio, CASE WHEN blank THEN 0 ELSE round(digits / n::DOUBLE, 9) END::DOUBLE AS digit_ratio,
  CASE WHEN blank OR len(w) = 0 THEN 0 ELSE round(len(list_filter(w, lambda x: length(x) > 1 AND list_contains([{', '.join(f"'{x}'" for x in sorted(ALL_FUNCTION_WORDS))}], lower(x)))) / len(w)::DOUBLE, 9) END::DOUBLE AS common_share,
  CASE WHEN blank THEN 0 ELSE round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?;:؟。…"''”’)]{_BLANK}*$'))) / len(lines)::DOUBLE, 9) END::DOUBLE AS punctuated_lines,
  CASE WHEN blank THEN 0 ELSE len(lines) END AS n_lines FROM s"""


# Problem 3 ------------------------------------------------------------------

def _line_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    paragraphs = table(spark, folder, PARAGRAPHS, "para_id", "filename", "text")
    lines = materialize(boilerplate.numbered_lines(paragraphs), "lines")
    over = materialize(boilerplate.repeated_lines(lines, paragraphs), "repeated-lines")
    return lines, over


def _found_lines(lines: DataFrame, over: DataFrame) -> DataFrame:
    return lines.join(over.select("source", "line"), ["source", "line"], "left_semi").select(F.col("key").alias("para_id"), "line_no")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _found_lines(*_line_tables(spark, folder))


def p3_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The repeated lines of each source, told by the first place where they stand, and their counts."""
    lines, over = _line_tables(spark, folder)
    sample = lines.join(over.select("source", "line"), ["source", "line"], "left_semi").groupBy("source", "line").agg(
        F.min(F.struct("key", "line_no")).alias("first"))
    return over.join(sample, ["source", "line"]).select(
        "source", "n_files", "files_of_source", "n_clusters", "n_dates", "boilerplate",
        F.col("first.key").alias("para_id"), F.col("first.line_no").alias("line_no"))


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    lines, over = _line_tables(spark, folder)
    return boilerplate.without_lines(table(spark, folder, PARAGRAPHS, "para_id", "text"), _found_lines(lines, over))


_LINES = r"""
WITH l AS (
  SELECT para_id, filename, text, regexp_extract(filename, '([A-Z]{3})-[0-9]', 1) AS source,
         unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM processed_paragraphs_filtered WHERE text IS NOT NULL),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(raw), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS line FROM l),
files AS (SELECT regexp_extract(filename, '([A-Z]{3})-[0-9]', 1) AS source, count(DISTINCT filename) AS n_all
          FROM processed_paragraphs_filtered GROUP BY 1),
often AS (SELECT source, line, count(DISTINCT filename) AS n_files,
                 count(DISTINCT trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\s+', ' ', 'g'))) AS n_clusters,
                 count(DISTINCT regexp_extract(filename, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS n_dates,
                 min(struct_pack(p := para_id, l := CAST(line_no AS BIGINT))) AS first
          FROM n WHERE len(string_split(line, ' ')) >= 5 GROUP BY 1, 2),
kept AS (SELECT * FROM often JOIN files USING (source) WHERE n_files >= 5 AND n_files >= n_all * 0.2 AND source <> '')
"""
P3_FOUND = _LINES + "SELECT para_id, CAST(line_no AS BIGINT) AS line_no FROM n JOIN kept USING (source, line)"
P3_LINES = _LINES + """SELECT source, n_files, n_all AS files_of_source, n_clusters, n_dates, n_clusters >= 3 AND n_dates >= 2 AS boilerplate,
  first.p AS para_id, first.l AS line_no FROM kept"""
P3_CLEANED = _LINES + """, kept_lines AS (
  SELECT para_id, string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE k.line IS NULL) AS text, count(k.line) AS n_removed
  FROM n LEFT JOIN kept k USING (source, line) GROUP BY para_id)
SELECT p.para_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n_removed, 0)::INT AS n_removed
FROM processed_paragraphs_filtered p LEFT JOIN kept_lines k USING (para_id)"""


# Problem 4 ------------------------------------------------------------------

def _language_model(spark: SparkSession, folder: str) -> language.LanguageModel:
    rows = language.training_rows(table(spark, folder, PARAGRAPHS, "para_id", "text"), table(spark, folder, "paragraph_langs", "para_id", "lang_label"))
    return language.fit(rows)


def p4_stretches(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_stretches(table(spark, folder, PARAGRAPHS, "para_id", "text"), _language_model(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "paragraph_langs", "para_id", "lang_label")
    return language.unnamed_languages(p4_stretches(spark, folder), labels)


# Problem 5 ------------------------------------------------------------------

def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    paragraphs = table(spark, folder, PARAGRAPHS, "para_id", "text")
    return near_duplicates.expand_pairs(paragraphs, near_duplicates.similar_classes(paragraphs, width=3, least=0.6, min_words=40))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The class, group and number of links of every paragraph, at the pipeline's five words and 0.8."""
    paragraphs = table(spark, folder, PARAGRAPHS, "para_id", "text")
    return near_duplicates.groups(paragraphs, near_duplicates.similar_classes(paragraphs))


P5_FOUND = r"""
WITH w AS (SELECT para_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM processed_paragraphs_filtered WHERE text IS NOT NULL),
p AS (SELECT para_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 40),
g AS (SELECT DISTINCT para_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM p),
n AS (SELECT para_id, count(*) AS n FROM g GROUP BY para_id),
o AS (SELECT a.para_id AS para_id_a, b.para_id AS para_id_b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.para_id < b.para_id GROUP BY 1, 2)
SELECT para_id_a, para_id_b FROM o JOIN n x ON x.para_id = para_id_a JOIN n y ON y.para_id = para_id_b WHERE o >= 0.6::DOUBLE * (x.n + y.n - o) - 1e-9
"""


P5_GROUPS = r"""
WITH RECURSIVE w AS (SELECT text, min(para_id) AS class, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM processed_paragraphs_filtered WHERE text IS NOT NULL GROUP BY text),
p AS (SELECT class, w, unnest(range(1, len(w) - 3)) AS i FROM w),
g AS (SELECT DISTINCT class, array_to_string(w[i:i + 4], ' ') AS g FROM p),
n AS (SELECT class, count(*) AS n FROM g GROUP BY class),
o AS (SELECT a.class AS a, b.class AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.class <> b.class GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.class = a JOIN n y ON y.class = b WHERE o >= 0.8::DOUBLE * (x.n + y.n - o) - 1e-9),
r(class, other) AS (SELECT class, class FROM w UNION SELECT r.class, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT class, min(other) AS grp FROM r GROUP BY class),
d AS (SELECT a AS class, count(*) AS n_links FROM l GROUP BY a)
SELECT para_id, coalesce(w.class, para_id) AS class, coalesce(grp, para_id) AS "group", coalesce(n_links, 0) AS n_links
FROM processed_paragraphs_filtered t LEFT JOIN w ON w.text = t.text LEFT JOIN c ON c.class = w.class LEFT JOIN d ON d.class = w.class
"""


# Problem 6 ------------------------------------------------------------------

def _term_store(spark: SparkSession, folder: str) -> term_counts.TermCountStore:
    """The store after two deliveries.

    The first holds the rows of the first years, those without a year as text
    and file name in one.  The second corrects these (the old text goes, the
    right one comes) and adds all later rows.
    """
    rows = table(spark, folder, PARAGRAPHS, "text", "filename", "year", "ingested_at")
    early = F.coalesce(F.col("ingested_at") < F.lit("2020-01-01").cast("timestamp_ntz"), F.lit(False))
    wrong = early & (F.coalesce("year", F.lit("")) == "")
    delivered = F.concat_ws(" ", "filename", "text")
    store = term_counts.TermCountStore(spark, fresh_path(spark, "term-store"))
    store.apply(rows.where(early).select(F.when(F.col("text").isNotNull() & wrong, delivered).otherwise(F.col("text")).alias("text")))
    taken_back = rows.where(wrong & F.col("text").isNotNull()).select(delivered.alias("text"), F.lit(-1).alias("sign"))
    added = rows.where(wrong | ~early).select("text", F.lit(1).alias("sign"))
    store.apply(taken_back.unionByName(added), sign="sign")
    return store


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    marked = term_counts.mark_terms(_term_store(spark, folder).terms())
    return marked.select("term", "occurrences", "records", "mark")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts.mark_terms(_term_store(spark, folder).terms()).where("mark is not null").select("term", "mark")


_TERMS = r"""
WITH p AS (SELECT para_id, list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda x: length(x) >= 3) AS terms
           FROM processed_paragraphs_filtered WHERE text IS NOT NULL),
t AS (SELECT para_id, unnest(terms) AS term FROM p),
c AS (SELECT term, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT para_id) AS BIGINT) AS records FROM t GROUP BY term),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > (SELECT count(*) FROM p) * 0.2 THEN 'common' END AS mark FROM c)
"""
P6_COUNTS = _TERMS + "SELECT term, occurrences, records, mark FROM m"
P6_FOUND = _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL"


# Problem 7 ------------------------------------------------------------------

def p7_scores(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.term_scores(table(spark, folder, PARAGRAPHS, "para_id", "text")).withColumn("score", F.round("score", 5))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The scored terms that occur three times or more, in at most four paragraphs; the score orders them and removes none."""
    scores = distinctive.term_scores(table(spark, folder, PARAGRAPHS, "para_id", "text"), min_count=3, max_records=4)
    return scores.where((F.col("tf") >= 3) & (F.col("records") <= 4) & F.col("score").isNotNull()).select("para_id", "term")


P7_FOUND = _TERMS + """, f AS (SELECT para_id, term, count(*) AS tf FROM t GROUP BY para_id, term)
SELECT para_id, term FROM f JOIN c USING (term) WHERE tf >= 3 AND records <= 4"""


# the mixture of every term by 40 rounds over its histogram, all records without the term in one cell
P7_SCORES = _TERMS.replace("WITH p", "WITH RECURSIVE p", 1) + """, f AS (SELECT para_id, term, count(*) AS tf FROM t GROUP BY para_id, term),
h AS (SELECT term, tf::DOUBLE AS x, count(*)::DOUBLE AS n FROM f GROUP BY term, tf UNION ALL SELECT term, 0, (SELECT count(*) FROM p) - records FROM c),
s AS (SELECT term, sum(n) AS total, sum(n) FILTER (x > 0) AS records, sum(n * x) AS occ, max(x) AS top FROM h GROUP BY term),
em(k, term, share, low, high) AS (
  SELECT 0, term, least(greatest(records / total * 0.5::DOUBLE, 1e-9), 0.5::DOUBLE), greatest(occ / total * 0.5::DOUBLE, 1e-9),
    greatest(occ / records, 0.5::DOUBLE * top, greatest(occ / total * 0.5::DOUBLE, 1e-9) * 4) FROM s
  UNION ALL
  SELECT k + 1, term, least(greatest(m1 / (m1 + m0), 1e-12), 1 - 1e-12::DOUBLE), least(lo, hi), greatest(lo, hi) * (1 + 1e-9::DOUBLE) FROM (
    SELECT k, term, m1, m0, greatest(o1 / greatest(m1, 1e-12), 1e-8) AS hi, greatest(o0 / greatest(m0, 1e-12), 1e-9) AS lo FROM (
      SELECT k, term, sum(e * n) AS m1, sum((1 - e) * n) AS m0, sum(e * n * x) AS o1, sum((1 - e) * n * x) AS o0 FROM (
        SELECT k, term, n, x, 1 / (1 + exp(-least(greatest(ln(share / (1 - share)) + x * ln(high / low) - (high - low), -500), 500))) AS e FROM em JOIN h USING (term) WHERE k < 40)
      GROUP BY k, term)))
SELECT para_id, term, CAST(tf AS INT) AS tf, records, round(1 / (1 + exp(-least(greatest(ln(share / (1 - share)) + tf * ln(high / low) - (high - low), -500), 500))), 5) AS score
FROM f JOIN c USING (term) JOIN em USING (term) WHERE k = 40"""


# Problem 8 ------------------------------------------------------------------

def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, folder, "documents", "doc_id", "text"))


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens, and how many texts the decoded ids do not give back (none)."""
    documents = table(spark, folder, "documents", "doc_id", "text")
    ids = materialize(tokenize.encode_corpus(documents), "ids")
    back = tokenize.decode_corpus(ids).select("doc_id", F.xxhash64("text").alias("back"))
    same = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("was")).join(back, "doc_id")
    tokens = ids.select("doc_id", F.size("ids").alias("n"))
    return same.join(tokens, "doc_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"),
        F.sum((F.col("was") != F.col("back")).cast("bigint")).alias("broken"))


# Problem 9 ------------------------------------------------------------------

def _leak_search(spark: SparkSession, folder: str, paraphrases: bool) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text")
    index = leaks.fit(documents, table(spark, folder, "eval_items", "item_id", "text"))
    return leaks.search(documents, index, paraphrases=paraphrases)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leak_search(spark, folder, False).select("doc_id", "item_id")


P9_FOUND = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dr AS (SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS r FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
er AS (SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS r FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT dr.id AS doc_id, er.id AS item_id FROM dr JOIN er USING (r)
"""


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """All leaks with their longest run, common subsequence and answers told, paraphrases included."""
    return _leak_search(spark, folder, True)


# Problem 10 -----------------------------------------------------------------

def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text")
    return personal.found_values(documents, personal.fit(documents))


def p10_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text")
    return personal.replaced(documents, personal.fit(documents))


def p10_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Under the session's key ``paraloom.surrogate.key``; a key of its own belongs to every release of a corpus."""
    documents = table(spark, folder, "documents", "doc_id", "text")
    names = personal.fit(documents)
    secret = spark.conf.get("paraloom.surrogate.key", "no secret: a key for tests")
    return personal.replaced(documents, names, surrogates=personal.fit_surrogates(documents, names, secret))


def p10_entities(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text")
    return personal.entities(documents, personal.fit(documents))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_repaired": p1_repaired,
        "p2_found": p2_found, "p2_statistics": p2_statistics, "p2_shares": p2_shares,
        "p3_found": p3_found, "p3_lines": p3_lines, "p3_cleaned": p3_cleaned,
        "p4_found": p4_found, "p4_stretches": p4_stretches,
        "p5_found": p5_found, "p5_groups": p5_groups,
        "p6_found": p6_found, "p6_counts": p6_counts,
        "p7_found": p7_found, "p7_scores": p7_scores,
        "p10_found": p10_found, "p10_placeholders": p10_placeholders, "p10_surrogates": p10_surrogates, "p10_entities": p10_entities,
        "p9_found": p9_found, "p9_leaks": p9_leaks,
        "p8_ids": p8_ids, "p8_round_trip": p8_round_trip,
    }


def oracle_sql() -> dict[str, str]:
    return {"p2_shares": P2_SHARES, "p3_found": P3_FOUND, "p3_lines": P3_LINES, "p3_cleaned": P3_CLEANED, "p5_found": P5_FOUND, "p9_found": P9_FOUND, "p6_found": P6_FOUND, "p6_counts": P6_COUNTS, "p5_groups": P5_GROUPS, "p7_found": P7_FOUND, "p7_scores": P7_SCORES}
