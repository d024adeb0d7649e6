import zlib

import pytest
from pyspark.sql import functions as F

from paraloom.functions import language, periods, text
from paraloom.functions.stopwords import enhanced_stopwords
from paraloom.operators import quality
from paraloom.sources import pages
from paraloom.sources.pdf import pdf_pages


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_ocr_clean_takes_numbers_first(spark):
    got = column(spark, ["See Figure 3 and Figure3 and Table 4a 12 | 13 end", "at a@b.org see http://x.org/a#b now", None, ""], text.ocr_clean)
    assert got == ["See Figure and and a end", "at see #b now", None, ""]


def test_corpus_clean(spark):
    got = column(spark, ["ISBN-: ---- a....b (x (y)) 1.2.3.4 end", "7. Figure 2 done", "(all gone)", None], text.corpus_clean)
    assert got[0].startswith("a b") and got[1:] == ["done", "", None]


def test_year_from_filename(spark):
    assert column(spark, ["document_2019-05-01_X.pdf", "other.pdf"], text.year_from_filename) == ["2019", ""]


def test_parse_year(spark):
    assert column(spark, ["2018", "2018.0", "", None, "x", "2018.5"], text.parse_year) == [2018, 2018, None, None, None, None]
    with pytest.raises(Exception):
        column(spark, [""], lambda c: text.parse_year(c, "fail"))


def test_period_label(spark):
    assert column(spark, [2016, 2017, 2020, 2021, 2026, None], periods.period_label, "int") == ["Other", "Trump", "Trump", "Biden", "Biden", "Other"]


def test_label_words(spark):
    assert column(spark, ["0_HIV Prevention Programs___", "0_malaria_net"], text.label_words) == [["HIV Prevention Programs", "", "", ""], ["malaria", "net"]]


def test_stopwords_have_no_repeats():
    words = enhanced_stopwords()
    assert len(words) == len(set(words)) and {"agreement", "fy17", "de la", "the"} <= set(words)


def rules(spark, values, lang=None):
    df = spark.createDataFrame([(i, v, lang) for i, v in enumerate(values)], "i int, paragraph string, lang string")
    return [r[0] for r in quality.with_reason(df, "lang").orderBy("i").select("skip_reason").collect()]


def test_rules_in_order(spark):
    ten = "one two three four five six seven eight nine ten"
    got = rules(spark, ["." * 147, "." * 146 + f" {ten}", f"ACRONYMS AND ABBREVIATIONS {ten}", "ก " + ten, ten, "too short", "12345 " * 10,
                        ten.upper(), f"However, {ten}", f"1. {ten}", "1 2 3 4 5 6 7 8 9 0"])
    assert got == ["table_of_contents", None, "acronyms", "non_latin", None, "short_paragraph", "too_many_numbers", "all_caps", "references", "references", "too_many_numbers"]
    assert rules(spark, [ten], "fr") == ["unwanted_language"] and rules(spark, [ten], "de") == [None]


def test_digit_share_of_exactly_a_fifth_is_kept(spark):
    assert rules(spark, ["1a 2b cd ef 3g hi 4j kl mn opq"])[0] is None


def test_counts_have_all_reasons(spark):
    df = spark.createDataFrame([("short_paragraph",), (None,)], "skip_reason string")
    got = {r[0]: r[1] for r in quality.skip_counts(df).collect()}
    assert len(got) == 8 and got["short_paragraph"] == 1 and sum(got.values()) == 1


def test_paragraphs_trim_and_drop_empty(spark):
    df = spark.createDataFrame([(1, "a\n\n \t\n\n b "), (2, ""), (3, None)], "doc_id int, text string")
    assert [(r.doc_id, r.para_idx, r.paragraph) for r in quality.paragraphs(df).orderBy("para_idx").collect()] == [(1, 0, "a"), (1, 2, "b")]


def test_page_reader_isolates_errors(spark, tmp_path):
    (tmp_path / "document_2019-05-01_A.pdf").write_bytes(("word " * 12 + "\f").encode() + b"\xff\xfe\xff" + ("\fx\n\n" + "term " * 11).encode())
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 trailer << /Encrypt 1 0 R >>")
    (tmp_path / "X.PDF").write_bytes(b"not listed")
    read = pages.read_pages(spark, str(tmp_path))
    rows = read.orderBy("filename", "page_num").collect()
    assert [(r.filename, r.page_num, r.error is None) for r in rows] == [
        ("bad.pdf", None, False), ("document_2019-05-01_A.pdf", 1, True), ("document_2019-05-01_A.pdf", 2, False), ("document_2019-05-01_A.pdf", 3, True)]
    found = pages.page_paragraphs(read)
    assert {(r.page_num, r.year, r.skip_reason) for r in found.collect()} == {(1, "2019", None), (3, "2019", "short_paragraph"), (3, "2019", None)}


def pdf(*pages_of_text, compress=True, object_stream=False, broken=()):
    """A small PDF file: a page for each content stream."""
    n = len(pages_of_text)
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>",
             2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + i) for i in range(n)) + b"] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>",
             3: b"<< /Type /Font /Subtype /Type1 >>", 4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"}
    plain |= {10 + i: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (100 + i) for i in range(n)}
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0E01> endbfchar 2 beginbfrange <0002> <0004> <0061> <0005> <0006> [<00660069> <0078>] endbfrange"
    streams = {5: cmap, **{100 + i: t for i, t in enumerate(pages_of_text)}}
    out = b"%PDF-1.5\n"
    if object_stream:
        body, head = b"", b""
        for number, value in plain.items():
            head += b"%d %d " % (number, len(body))
            body += value + b" "
        data = zlib.compress(head + body)
        out += b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n" % (len(plain), len(head), len(data)) + data + b"\nendstream endobj\n"
    else:
        out += b"".join(b"%d 0 obj %s endobj\n" % x for x in plain.items())
    for number, data in streams.items():
        data, about = (zlib.compress(data), b"/Filter /FlateDecode ") if compress else (data, b"")
        data = b"not deflated" if number - 100 in broken else data
        out += b"%d 0 obj << %s/Length %d >> stream\n" % (number, about, len(data)) + data + b"\nendstream endobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


FIRST = rb"BT /F1 10 Tf 14 TL 72 700 Td (The ministry \(of health\)) Tj T* (found that \163upply) Tj 0 -30 Td [(had im) -20 (proved) -300 (since)] TJ ET"
SECOND = rb"BT /F2 10 Tf 1 0 0 1 72 700 Tm <00010002000300040005> Tj 1 0 0 1 90 700 Tm <0006> Tj ET"


@pytest.mark.parametrize("how", [{}, {"compress": False}, {"object_stream": True}])
def test_text_layer_of_pdf_files(how):
    got = list(pdf_pages(pdf(FIRST, SECOND, b"", **how)))
    assert got == ["The ministry (of health)\nfound that supply\n\nhad improved since", "\u0e01abcfi x", ""]


def test_a_page_that_cannot_be_read_leaves_the_others():
    got = list(pdf_pages(pdf(FIRST, SECOND, FIRST, broken=(1,))))
    assert got[0] == got[2] and isinstance(got[1], Exception)
    with pytest.raises(ValueError, match="no PDF"):
        list(pdf_pages(b"text"))


def test_corpus_is_built_and_loaded(spark, tmp_path, caplog):
    long = b"BT /F1 10 Tf 72 700 Td (" + b"the ministry of health found that supply of the nets was better (1.2.3) than it had been " * 2 + rb") Tj ET"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "document_2019-05-01_A.pdf").write_bytes(pdf(long, rb"BT /F1 10 Tf 72 700 Td (too short) Tj ET", long, broken=(2,)))
    (tmp_path / "in" / "document_2022-05-01_B.pdf").write_bytes(pdf(long.replace(b"the", b"le").replace(b"of", b"des").replace(b"was", b"est").replace(b"that", b"que")))
    (tmp_path / "in" / "other.pdf").write_bytes(pdf(long))
    with caplog.at_level("INFO", "paraloom.pages"):
        built = pages.build_corpus(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {r.skip_reason: r.n for r in built.counts.where("n > 0").collect()} == {"short_paragraph": 1, "unwanted_language": 1}
    assert [(r.filename, r.page_num) for r in built.errors.collect()] == [("document_2019-05-01_A.pdf", 3)]
    assert "5 pages, 1 not read" in caplog.text and "short_paragraph: 1 paragraphs" in caplog.text
    loaded = pages.load_corpus(spark, str(tmp_path / "out"))
    rows = loaded.collect()
    assert [(r.filename, r.year, r.administration) for r in rows] == [("document_2019-05-01_A.pdf", 2019, "Trump")] and "1.2.3" not in rows[0].text
    assert [tuple(r) for r in pages.yearly_paragraphs(loaded).collect()] == [(2019, 1)]


def test_languages_by_script_and_words(spark):
    texts = ["the supply of nets in the wards was for all", "le pays et les villages des environs", "el agua de los pueblos y las escuelas con más", "yang dan di dengan untuk desa",
             "o estado das escolas não foi mais que uma", "der Stand und die Lage mit den Schulen", "\u0e01\u0e02\u0e03 text", "\u0642\u0627\u0645\u062a", "12 34", "", None, "Kandor Pimar"]
    assert column(spark, texts, language.detect_language) == ["en", "fr", "es", "id", "pt", "de", "th", "ar", None, None, None, None]


def test_unicode_and_ascii_classes(spark):
    wide = "one\u00a0two\u3000three four five six seven eight nine ten"
    df = spark.createDataFrame([(wide,), ("\u0661\u0662\u0663\u0664 " * 10 + wide,), ("Word\u3000, and then " + wide,)], "paragraph string")
    reasons = lambda u: [r[0] for r in quality.with_reason(df, unicode=u).select("skip_reason").collect()]
    assert reasons(True) == [None, "non_latin", "references"] and reasons(False) == ["short_paragraph", "non_latin", None]
    got = column(spark, ["a \u0967\u0968 b \u00e9@x.org", "a 12 | 13abc"], text.ocr_clean)
    assert got == ["a b", "a abc"] and column(spark, ["a \u0967 b"], lambda c: text.ocr_clean(c, unicode=False)) == ["a \u0967 b"]
    spaced = spark.createDataFrame([(1, "\u00a0a\u2003\n\n\u3000")], "doc_id int, text string")
    assert [r.paragraph for r in quality.paragraphs(spaced).collect()] == ["a"]


def test_tokens_are_words_of_letters_only(spark):
    got = column(spark, ["COVID-19 and/or well-known (nets), ministry's don't e.g. U.S. 'beds' x--pumps.", "naïve café2 été", None], text.letter_tokens)
    assert got == [["nets", "ministry", "beds", "pumps"], ["naïve", "été"], None]


def test_corpus_csv_round_trip(spark, tmp_path):
    rows = [("document_2019-01-01_A.pdf", "2019", ' say "hi", twice\nand on '), ("b.pdf", "", "no year"), ("document_2020-01-01_C.pdf", "2020", "NA")]
    df = spark.createDataFrame([(*r, None) for r in rows], "filename string, year string, text string, skip_reason string")
    pages.write_corpus(df, str(tmp_path / "csv"))
    got = {(r.filename, r.year, r.text) for r in pages.read_corpus(spark, str(tmp_path / "csv")).collect()}
    assert got == {("document_2019-01-01_A.pdf", 2019, ' say "hi", twice\nand on '), ("document_2020-01-01_C.pdf", 2020, "nan")}
    with pytest.raises(Exception):
        pages.read_corpus(spark, str(tmp_path / "csv"), bad_year="fail").collect()


def test_timestamp_year(spark):
    assert column(spark, [2016.7, 2015.993], lambda c: periods.timestamp_year(c, "double"), "double") == [2016, 2015]
    assert column(spark, ["2017-05-01 x", "none", None], lambda c: periods.timestamp_year(c, "string")) == [2017, None, None]


def test_result_tables_keep_their_columns(spark, tmp_path):
    from paraloom.sources.tables import write_table

    df = spark.createDataFrame([("a,b", 'say "x"\nthen', [1, 2])], "z string, a string, l array<int>")
    path = write_table(df, str(tmp_path), "t", "csv", single_file=True)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert back.columns == ["z", "a", "l"] and tuple(back.first()) == ("a,b", 'say "x"\nthen', "[1,2]")
    assert spark.read.parquet(write_table(df, str(tmp_path), "p")).first().l == [1, 2]


def test_short_label(spark):
    df = spark.createDataFrame([(1, "x" * 31), (2, "short")], "t int, n string")
    assert [r[0] for r in df.select(text.short_label(F.col("t"), F.col("n"))).collect()] == ["1: " + "x" * 30 + "...", "2: short"]
