import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paraloom.llm import boilerplate, distinctive, language, leaks, near_duplicates, personal, queries, scan_noise, term_counts, text_quality, tokenize
from paraloom.session import fresh_path

WORDS = "the ministry of health reviewed clinics in every district and found that supply had improved slowly since the rains".split()
SENTENCE = "The ministry of health reviewed the clinics in Kandor and found that supply had improved since 2019."


def frame(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts, 1)]
    df = spark.createDataFrame(rows, "para_id bigint, text string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()}) if more else df


# Problem 6 and 7

def plain_counts(texts):
    occ, rec = collections.Counter(), collections.Counter()
    for t in texts:
        if t is not None:
            terms = [w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 3]
            occ.update(terms)
            rec.update(set(terms))
    return {w: (occ[w], rec[w]) for w in occ}


def test_counts_after_additions_changes_and_deletions(spark):
    store = term_counts.TermCountStore(spark, fresh_path(spark, "store"))
    assert store.terms().count() == 0
    first = ["net bed net", None, "", "Bed pump"]
    store.apply(frame(spark, first))
    changes = spark.createDataFrame([("Bed pump", -1), ("bed well well", 1), ("net bed net", -1)], "text string, sign int")
    version = store.apply(changes, sign="sign", stream="s", batch=0)
    got = {r.term: (r.occurrences, r.records) for r in store.terms().collect()}
    assert got == plain_counts(["", "bed well well"]) and {r.total for r in store.terms().collect()} == {2}
    assert store.apply(changes, sign="sign", stream="s", batch=0) == version  # a retried batch changes nothing
    assert {r.term: (r.occurrences, r.records) for r in store.terms().collect()} == got


def test_only_touched_buckets_are_written_and_old_files_go(spark):
    store = term_counts.TermCountStore(spark, fresh_path(spark, "store"), buckets=8)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    store.apply(frame(spark, [" ".join(words)]))
    before = store._newest()["files"]
    store.apply(frame(spark, [words[0]]))
    after = store._newest()["files"]
    assert sum(after[b] != v for b, v in before.items()) <= 2 < len(before)  # the word's and the total's
    for _ in range(3):
        store.apply(frame(spark, [words[0]]))
    assert len(store._versions()) == term_counts.VERSIONS_KEPT
    got = {r.term: (r.occurrences, r.records) for r in store.terms().collect()}
    assert got == plain_counts([" ".join(words), *[words[0]] * 4])
    kept = {(int(v[2:]), int(b[7:])) for v in store._children(f"{store.path}/data") for b in store._children(f"{store.path}/data/{v}") if b.startswith("bucket=")}
    assert len(kept) <= len(before) + 4


def test_deltas_on_empty_and_clashing_columns(spark):
    empty = frame(spark, ["x"]).where("false")
    assert term_counts.term_deltas(empty).count() == 0
    clash = frame(spark, ["one two two"], term="z", records=7, _t=1)
    assert {r.term: r.occurrences for r in term_counts.term_deltas(clash).collect()} == {"": 0, "one": 1, "two": 2}


def test_counts_follow_a_stream(spark, tmp_path):
    store = term_counts.TermCountStore(spark, str(tmp_path / "store"))
    source = str(tmp_path / "in")
    schema = "text string, sign int"
    for rows in ([("net bed net", 1), ("Bed pump", 1)], [("Bed pump", -1), ("well", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        assert term_counts.follow(stream, store, str(tmp_path / "state"), sign="sign").awaitTermination(120)
    assert {r.term: (r.occurrences, r.records) for r in store.terms().collect()} == plain_counts(["net bed net", "well"])
    # a stream with a state of its own over the same store goes on from there
    more = str(tmp_path / "more")
    spark.createDataFrame([("pump", 1)], schema).write.parquet(more)
    assert term_counts.follow(spark.readStream.schema(schema).parquet(more), store, str(tmp_path / "other"), sign="sign").awaitTermination(120)
    assert {r.term: (r.occurrences, r.records) for r in store.terms().collect()} == plain_counts(["net bed net", "well", "pump"])


def test_a_third_of_all_rows_may_be_one_text(spark):
    rows = [(i, SENTENCE) for i in range(300)] + [(1000 + i, f"{SENTENCE} number{i} pump{i} well{i}") for i in range(5)] + [(2000 + i, f"own{i} words{i} of{i} text{i} here{i}") for i in range(595)]
    df = spark.createDataFrame(rows, "para_id bigint, text string")
    similar = near_duplicates.similar_classes(df, width=3, least=0.6)
    assert similar.links.count() == 5 + 10  # between classes, not between copies
    groups = {r.para_id: r["group"] for r in near_duplicates.groups(df, similar).collect()}
    assert len({groups[i] for i in range(300)} | {groups[1000 + i] for i in range(5)}) == 1 and len(set(groups.values())) == 596


def test_marks(spark):
    terms = spark.createDataFrame([("a", 2, 10), ("b", 3, 10), ("c", 2, 11), ("d", 2, 9)], "term string, records int, total int")
    got = {r.term: r.mark for r in term_counts.mark_terms(terms).collect()}
    assert got == {"a": "rare", "b": "common", "c": "rare", "d": "rare"}


def test_mixture_separates_mentions_from_topics():
    share, low, high = distinctive.fit_mixtures(np.array([[1, 6, 0], [1, 2, 0]]), np.array([[40, 5, 0], [30, 3, 0]]), np.array([955, 967]))
    assert high[0] > 4 and low[0] < 0.2 and share[0] < 0.02


def test_scores_against_brute_force(spark):
    texts = ["alpha alpha alpha beta", "beta", None, "", "gamma gamma gamma", *["beta filler words here"] * 20, "alpha"]
    got = {(r.para_id, r.term): (r.tf, r.records) for r in distinctive.term_scores(frame(spark, texts, score=1, tf=2)).collect()}
    counts = [collections.Counter(distinctive.terms_of(t or "")) for t in texts]
    records = collections.Counter(w for c in counts for w in c)
    assert got == {(i, w): (n, records[w]) for i, c in enumerate(counts, 1) for w, n in c.items()}
    best = distinctive.term_scores(frame(spark, texts), min_count=3, max_records=4).where("score >= 0.5").collect()
    assert {(r.para_id, r.term) for r in best} == {(1, "alpha"), (5, "gamma")}
    assert distinctive.term_scores(frame(spark, texts).where("false")).count() == 0


def plain_mixture(counts, zeros, rounds):
    """The same law, term by term and count by count."""
    values = [k for k, n in counts.items() for _ in range(n)] + [0] * zeros
    inside = [v for v in values if v]
    low = max(0.5 * sum(values) / len(values), 1e-9)
    high = max(sum(inside) / len(inside), 0.5 * max(inside), 4 * low)
    share = min(max(0.5 * len(inside) / len(values), 1e-9), 0.5)
    for _ in range(rounds):
        odds = {v: share * math.exp(-high) * high ** v / ((1 - share) * math.exp(-low) * low ** v) for v in set(values)}
        w = [odds[v] / (1 + odds[v]) for v in values]
        high = max(sum(a * v for a, v in zip(w, values)) / max(sum(w), 1e-12), 1e-8)
        low = max(sum((1 - a) * v for a, v in zip(w, values)) / max(len(values) - sum(w), 1e-12), 1e-9)
        low, high = min(low, high), max(low, high) * (1 + 1e-9)
        share = min(max(sum(w) / len(values), 1e-12), 1 - 1e-12)
    return lambda v: 1 / (1 + (1 - share) * math.exp(-low) * low ** v / (share * math.exp(-high) * high ** v))


def test_scores_against_another_fit(spark):
    rng = random.Random(6)
    texts = [" ".join(["pump"] * rng.choice([0, 0, 0, 1, 1, 5, 6]) + ["well"] * rng.choice([0, 1, 2, 3]) + ["here"]) for _ in range(120)]
    got = {(r.para_id, r.term): r.score for r in distinctive.term_scores(frame(spark, texts)).where("term <> 'here'").collect()}
    for term in ("pump", "well"):
        tf = [t.split().count(term) for t in texts]
        score = plain_mixture(collections.Counter(n for n in tf if n), tf.count(0), distinctive.EM_ROUNDS)
        assert all(got[i, term] == pytest.approx(score(n), abs=1e-6) for i, n in enumerate(tf, 1) if n)


def test_hot_and_rare_terms_score_alike(spark, monkeypatch):
    texts = [" ".join(["pump"] * (1 + i % 3) + [f"well{chr(97 + i % 7)}"]) for i in range(60)]
    df = frame(spark, texts)
    one = sorted(map(tuple, distinctive.term_scores(df).collect()))
    monkeypatch.setattr(distinctive, "HOT_TERMS", 0)  # none is hot
    assert one == sorted(map(tuple, distinctive.term_scores(df).collect())) and len(one) == 120


def test_rows_without_a_key(spark, tmp_path):
    """Null keys, file names, labels and titles are survived by every query, with the results the modules state."""
    rows = [(None, None, SENTENCE), (1, "document_2019-01-01_ABC-1.pdf", SENTENCE), (2, None, None), (None, "x", ""), (3, "x", SENTENCE + " pump pump pump")]
    df = spark.createDataFrame(rows, "para_id bigint, filename string, text string")
    df.withColumns({"year": F.lit(None).cast("string"), "ingested_at": F.lit(None).cast("timestamp_ntz"), "page_num": F.lit(1)}).write.parquet(str(tmp_path / "processed_paragraphs_filtered.parquet"))
    spark.createDataFrame([(None, None), (1, None)], "para_id bigint, lang_label string").write.parquet(str(tmp_path / "paragraph_langs.parquet"))
    spark.createDataFrame([(None, "T"), ("x", None)], "filename string, title string").write.parquet(str(tmp_path / "source_files.parquet"))
    spark.createDataFrame([(None, SENTENCE), (1, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, SENTENCE), (1, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    got = {name: query(spark, str(tmp_path)).collect() for name, query in queries.queries().items()}
    assert len(got["p2_statistics"]) == len(got["p5_groups"]) == len(got["p3_cleaned"]) == len(got["p1_repaired"]) == 5
    assert [tuple(r) for r in got["p7_found"]] == [(3, "pump")] and [tuple(r) for r in got["p5_found"]] == []
    assert {r.para_id for r in got["p7_scores"]} == {None, 1, 3} and len(got["p8_ids"]) == len(got["p10_placeholders"]) == 2


def test_every_query_on_empty_tables(spark, tmp_path):
    tables = {
        "processed_paragraphs_filtered": "para_id bigint, filename string, page_num int, year string, text string, ingested_at timestamp_ntz", "source_files": "filename string, title string",
        "paragraph_langs": "para_id bigint, lang_label string", "documents": "doc_id bigint, text string", "eval_items": "item_id bigint, text string"}
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.queries().items():
        rows = query(spark, str(tmp_path)).collect()
        assert rows == [] or name == "p8_round_trip" and rows[0].documents == 0, name


def test_one_very_long_record_hides_no_distinctive_term(spark, tmp_path):
    texts = ["alpha alpha alpha here", "alpha " * 60 + "filler " * 5000, "gamma gamma gamma", *["beta filler words here"] * 300]
    frame(spark, texts).write.parquet(str(tmp_path / "processed_paragraphs_filtered.parquet"))
    got = {(r.para_id, r.term) for r in queries.p7_found(spark, str(tmp_path)).collect()}
    assert got == {(1, "alpha"), (2, "alpha"), (3, "gamma")}


# Problem 3

def test_repeated_lines_by_brute_force(spark):
    rows, notice = [], "All rights reserved {} by the Kandor desk office"
    for i in range(12):
        name = f"document_20{10 + i}-01-02_ABC-00{i}.pdf"
        rows.append((i, name, f"Own words of text number {i} here\r\n" + (notice.format(i) if i < 7 else "other  line with five words") + "\nshort line"))
    rows += [(100, "document_2010-01-02_XYZ-1.pdf", None), (101, "nothing.pdf", "a b c d e"), (102, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "para_id bigint, filename string, text string")
    lines = boilerplate.numbered_lines(df)
    over = boilerplate.repeated_lines(lines, df)
    found = {(r.key, r.line_no) for r in lines.join(over, ["source", "line"], "left_semi").collect()}
    key = lambda x: re.sub(r"\s+", " ", re.sub("[0-9]+", "#", x.lower())).strip()
    files = collections.defaultdict(set)
    for i, f, t in rows:
        for x in (t or "").split("\n"):
            files[key(x)].add(f)
    # the own lines differ by their numbers only, so they are one line too
    want = {(i, n) for i, f, t in rows if "ABC" in f for n, x in enumerate(t.split("\n")) if len(key(x).split()) >= 5 and len(files[key(x)]) >= 5}
    assert found == want and len(want) > 12
    assert all(r.n_clusters >= 1 and r.n_dates >= 5 for r in over.collect())
    drop = lines.join(over, ["source", "line"], "left_semi").select(F.col("key").alias("para_id"), "line_no")
    cleaned = {r.para_id: (r.text, r.n_removed) for r in boilerplate.without_lines(df, drop).collect()}
    assert cleaned[0] == ("short line", 2) and cleaned[100] == (None, 0) and cleaned[101] == ("a b c d e", 0) and cleaned[102] == cleaned[0]


def test_a_republished_text_is_no_boilerplate(spark):
    body = "All of this article stands in many files of it"
    rows = [(i, f"document_20{10 + i}-01-02_ABC-00{i}.pdf", f"{body if i % 2 else body.upper()}\nand  page {i} follows on") for i in range(6)]
    rows += [(10 + i, f"document_20{10 + i}-01-02_ABC-01{i}.pdf", f"{'own ' * (i + 1)}text\nThe notice that stands below each of them") for i in range(6)]
    df = spark.createDataFrame(rows + rows[:3], "para_id bigint, filename string, text string")
    got = {(r.n_files, r.n_clusters, r.n_dates, r.boilerplate) for r in boilerplate.repeated_lines(boilerplate.numbered_lines(df), df).collect()}
    assert got == {(6, 1, 6, False), (6, 6, 6, True)}  # copies in other cases and with other numbers are one cluster


def test_no_lines_in_an_empty_table(spark):
    df = spark.createDataFrame([], "para_id bigint, filename string, text string")
    lines = boilerplate.numbered_lines(df)
    assert boilerplate.repeated_lines(lines, df).count() == 0


# Problem 2

@pytest.mark.parametrize("text, kind", [
    (None, "none"), ("", "none"), (" \n\t", "none"), (SENTENCE, "prose"), (SENTENCE.upper(), "prose"), ("1. " + SENTENCE + " " + SENTENCE, "prose"),
    ("- New nets\n- Old beds\n- Blue pumps\n- Red wells", "list"), ("1) steady nets in Kandor\n2) modest beds in Pimar\n3) annual pumps in Tole", "list"),
    ("Steady Nets ........ 4\nModest Beds ........ 9\nPumps ........ 11", "list"), ("ACRONYMS AND ABBREVIATIONS\nABC - A Big Clinic\nDEF\tDoor Every Fifth", "list"),
    ("Nets 2019 2020\nKandor 88 n/a\nPimar 17% 4\nTole - 5", "table"), ("Nets | 2019 | 2020  Kandor | 8 | -  Pimar | 17% | 4", "table"), ("a,b,c\nKandor,1,2\nPimar,3,n/a\nTole,5,6", "table"),
    ("xq9 7tz ^k2 r8mm v4l 9vz b4g 2h16 0gdx", "junk"), ("asdf qwe asdf zzz qwe asdf zzz qwe asdf", "junk"), ("(cid:12) \\x4f %3A (cid:9) \\xe2", "junk"), ("{}|<>~~^^#@ !!&&**((", "junk"),
])
def test_kinds(text, kind):
    assert text_quality.statistics(text)[-1] == kind == text_quality.kind_of(text)


STRUCTURED = [
    ("\n".join(f"{i}. The ministry of health found that supply in the wards had improved since the rains." for i in range(1, 6)), "list"),
    ("\n".join("- The clinics of the district were visited by the team, and that was\n  for the first time since the end of the rains." for _ in range(4)), "list"),
    ("\n".join("Nets for the clinics of the district that are to be kept\n    in the stores of the wards and the schools" for _ in range(4)), "list"),
    ("\n".join(f"Share of the women in the wards that were visited   {i}   {i + 7}%   -" for i in range(10, 15)), "table"),
    ("\n".join("- في هذه القرية كان من أجل ذلك" for _ in range(4)), "list"),
    ("The ministry of health reviewed the clinics in the wards and found\nthat supply had improved since the rains. It was for the first time\n- as the team said - that all of them had been\nvisited in 2019.", "prose"),
    ("    The ministry of health reviewed the clinics in the wards\nand found that supply had improved since the rains.\nThat was for the first time.\n    The team was in all of the wards and the schools\nof the district.\nIt had not been there before.", "prose"),
]


@pytest.mark.parametrize("text, kind", STRUCTURED)
def test_structure_decides_before_common_words(text, kind):
    assert text_quality.statistics(text)[-1] == kind == text_quality.kind_of(text)


def test_layout_decides_lists_and_tables(monkeypatch):
    texts = [("Nets ; 2019 ; 2020  Kandor ; 8 ;   Pimar ; 17% ; 4  Tole ;  ; 12", "table"), ("Nets 2019 2020\nKandor 26190 78.8% n/a\nPimar 417 -\nTole - 12", "table"),
             ("• Steady nets • Joint beds • Blue pumps • Red wells", "list"), ("Kandor: steady nets\nPimar: modest beds\nTole: annual pumps", "list"),
             ("Steady Nets ..... 2 Modest Beds ............ 5 Annual Pumps ..... 11", "list"), ("Steady nets\nModest blue beds\nOld pumps\nRed wells Kandor", "list")]
    assert [text_quality.kind_of(t) for t, _ in texts] == [k for _, k in texts]
    for part in ("_clear", "_layout"):
        monkeypatch.setattr(text_quality, part, lambda *_: None)
    assert not {text_quality.kind_of(t) for t, _ in texts} & {"list", "table"}  # nothing else tells them


def test_periods_of_indentation():
    assert text_quality._periodicity([0, 4, 4] * 4) == (pytest.approx(1), -3)
    assert text_quality._periodicity([2, 2, 2, 2]) == (0.0, 0) == text_quality._periodicity([])
    names = text_quality.NAMES
    assert text_quality.statistics("a\n  b\na\n  b\na\n  b")[names.index("indentation")] > 0.99


def test_statistics_table(spark):
    df = frame(spark, [SENTENCE, None, SENTENCE, "x" * 200_000], kind="clash", n_words=1)
    got = {r.para_id: r for r in text_quality.text_statistics(df).collect()}
    assert len(got) == 4 and got[1][1:] == got[3][1:] and got[1].n_words == 16 and got[2].kind == "none" and got[4].n_chars == 200_000
    assert text_quality.text_statistics(df.where("false")).count() == 0


# Problem 8

ENCODER = tokenize.encoder("byte_bpe_50k")
texts_for_bpe = st.text(alphabet=st.sampled_from("ab '\n\t 12é你　!’s<|>l"), max_size=80)


def plain_ids(text):
    encoding, _ = ENCODER
    return [i for piece in tokenize.pre_tokens(text) for i in encoding.encode_ordinary(piece)] if text else []


@settings(max_examples=200, deadline=None)
@given(texts_for_bpe, st.integers(8, 30))
def test_stitched_pieces_encode_alike(text, chunk):
    assert [p for piece in tokenize.stitched(text, chunk, chunk // 2) for p in piece] == tokenize.pre_tokens(text)
    ids = tokenize.encode_piece(text, *ENCODER, chunk, chunk // 2)
    assert ids == plain_ids(text) == ENCODER[0].encode_ordinary(text)
    assert tokenize.decode(ids) == text


@pytest.mark.parametrize("gap", ["\n\n", "\r\n\r\n", "\n\n\n", "  \n ", "　\n"])
def test_paragraph_breaks_round_a_chunk_start(gap):
    for at in range(20, 61):
        text = ("ab cd's " * 20)[:at] + gap + "word's of the next paragraph, and more of them to come 12 times"
        pieces = list(tokenize.stitched(text, 40, 20))
        assert len(pieces) > 1 and [p for x in pieces for p in x] == tokenize.pre_tokens(text), at


def test_runs_longer_than_chunks_only_lengthen_their_own_piece():
    text = "one two " * 10 + "x" * 500 + " three four" * 100
    pieces = ["".join(p) for p in tokenize.stitched(text, 40, 10)]
    assert "".join(pieces) == text and sum(len(p) < 120 for p in pieces) > 20


def test_paragraph_breaks_round_a_chunk_start_in_a_table(spark):
    rows = [(at, "ab" * (at // 2 - 4) + " " * (at % 2) + " ab cd ab"[:8] + "\n\nword of it " * 800) for at in range(9_985, 10_012)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in tokenize.encode_corpus(df, spread=10_000).collect()}
    assert got == {i: plain_ids(t) for i, t in rows}


def test_against_the_reference_encoder():
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(f"{tokenize.VOCABULARIES}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    for t in ["", "<|endoftext|> a", " " * 500 + "x", "a" * 3000, " \n \n\t x  ", "it's we'll 'S 1२3 ½ x", SENTENCE]:
        assert tokenize.encode_piece(t, *ENCODER) == own.encode(t, add_special_tokens=False).ids


def test_corpus_encoding_of_short_and_huge_texts(spark):
    rng = random.Random(3)
    huge = " ".join(rng.choice(WORDS) for _ in range(9000))
    run = "x" * 9000 + huge
    rows = [(1, None), (2, ""), (3, SENTENCE), (4, huge), (5, run), (6, SENTENCE)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit(1), "key": F.lit("k"), "k": F.lit(2)})
    got = {r.doc_id: r.ids for r in tokenize.encode_corpus(df, spread=10_000).collect()}
    assert got == {i: plain_ids(t or "") for i, t in rows}
    back = {r.doc_id: r.text for r in tokenize.decode_corpus(tokenize.encode_corpus(df, spread=10_000)).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert tokenize.encode_corpus(df.where("false")).count() == 0


# Problem 5

def brute_pairs(rows, width, least, min_words):
    grams = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if t is not None and len(w) >= min_words:
            grams[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}
    out = set()
    for a in grams:
        for b in grams:
            if a < b:
                both, union = len(grams[a] & grams[b]), len(grams[a] | grams[b])
                if union and both >= least * union - 1e-12:
                    out.add((a, b))
    return out


@pytest.mark.parametrize("width, least, min_words", [(3, 0.6, 8), (5, 0.8, 6), (3, 0.6, 40)])
def test_near_duplicates_by_brute_force(spark, width, least, min_words):
    rng = random.Random(width)
    base = [[rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(5, 70))] for _ in range(40)]
    rows = []
    for words in base:
        for _ in range(rng.randrange(1, 4)):
            new = list(words)
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(new))
                new[k:k + rng.randrange(2)] = [rng.choice(WORDS)]
            rows.append((len(rows), " ".join(new)))
    rows += [(900, None), (901, ""), (902, rows[0][1]), (903, rows[0][1]), (904, "one two three"), (905, "one two three")]
    df = spark.createDataFrame(rows, "para_id bigint, text string").withColumns({"class": F.lit(0), "id": F.lit("x"), "a": F.lit(1)})
    similar = near_duplicates.similar_classes(df, width=width, least=least, min_words=min_words)
    got = [(r[0], r[1]) for r in near_duplicates.expand_pairs(df, similar).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, width, least, min_words)
    groups = {r.para_id: (r["group"], r.n_links) for r in near_duplicates.groups(df, similar).collect()}
    assert len(groups) == len(rows) and groups[900] == (900, 0) and groups[902] == groups[903] == groups[0]
    pairs = brute_pairs([(i, t) for t, i in {t: i for i, t in reversed(rows)}.items()], width, least, min_words)
    parent = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    first = {t: i for i, t in reversed(rows)}
    assert all(groups[i][0] == (parent[first[t]] if t is not None else i) for i, t in rows)


def fragment_pairs(entries, fragment, least=0.8):
    batch = pa.RecordBatch.from_arrays([pa.array([fragment] * len(entries)), pa.array([near_duplicates._packed(e) for e in entries], pa.binary())], names=["fragment", "entries"])
    found = collections.Counter()
    for x in near_duplicates._fragment_pairs(least)(iter([batch])):
        for a, b, n in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), x.column("overlap").to_pylist()):
            found[a, b] += n
    return found


def crowd(n):
    e = np.zeros(n, near_duplicates.ENTRY)
    e["gram"], e["size"], e["text"] = 7, [20 + i % 9 for i in range(n)], np.arange(n)
    e["size"][:3] = near_duplicates.LONG
    return e


def test_crowded_posting_lists_lose_nothing(monkeypatch):
    e = crowd(30)
    want = fragment_pairs([e], 5)
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    monkeypatch.setattr(near_duplicates, "FLUSH_PAIRS", 10)
    assert fragment_pairs([e[:11], e[11:]], 5) == want and len(want) > 100


def test_blocks_of_a_crowded_n_gram_lose_nothing():
    e = crowd(50)
    fragment, entries = near_duplicates._in_blocks(e, np.full(50, 12345, np.uint64), np.full(50, 4))
    assert len(entries) == 200 and len(set(fragment.tolist())) == 4 + 6 and fragment.max() < 0
    found = collections.Counter()
    for f in set(fragment.tolist()):
        found += fragment_pairs([entries[fragment == f]], f)
    assert found == fragment_pairs([e], 5)
    assert np.array_equal(near_duplicates._unpacked(near_duplicates._packed(e)), e)


def test_a_crowd_of_near_copies_by_brute_force(spark, monkeypatch):
    rows = [(i, f"{SENTENCE} net{i} bed{i}") for i in range(60)] + [(100 + i, SENTENCE) for i in range(90)]
    df = spark.createDataFrame(rows, "para_id bigint, text string")
    monkeypatch.setattr(near_duplicates, "CROWD", 9)
    monkeypatch.setattr(near_duplicates, "CLASS_BLOCK", 20)
    monkeypatch.setattr(near_duplicates, "HOT_CLASSES", 5)
    got = [(r[0], r[1]) for r in near_duplicates.expand_pairs(df, near_duplicates.similar_classes(df, width=3, least=0.6)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, 3, 0.6, 1) and len(got) == 150 * 149 / 2


def test_more_ids_than_a_filter_holds(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "MOST_FILTER_BITS", 0)
    rows = [(1, SENTENCE), (2, SENTENCE + " again"), (3, SENTENCE), (4, "one two three four five")]
    df = spark.createDataFrame(rows, "para_id bigint, text string")
    got = {tuple(r) for r in near_duplicates.expand_pairs(df, near_duplicates.similar_classes(df, width=3, least=0.6)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}


def test_texts_that_share_phrases_but_are_not_similar_leave_little_on_disk(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TASK_BYTES", 20_000)
    rng = random.Random(5)
    phrases = [" ".join(f"w{k}x{j}" for j in range(3)) for k in range(20)]
    rows = [(i, " ".join(rng.sample(phrases, 15))) for i in range(1500)]
    rows += [(2000 + i, rows[i][1] + " again") for i in range(20)]
    df = spark.createDataFrame(rows, "para_id bigint, text string")
    written = lambda: sum(x.totalShuffleWrite() for x in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = written()
    near_duplicates.similar_classes(df, width=3, least=0.6).links.count()
    assert written() - before < 2.5e6  # 5.5e6 where every pair that meets in an n-gram is written


def test_passes_and_sketches_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "ENTRIES_PER_PASS", 10)
    monkeypatch.setattr(near_duplicates, "CROWD", 9)
    rng = random.Random(6)
    base = [[rng.choice(WORDS) for _ in range(n)] for n in (12, 30, 60, 150, 400, 900) for _ in range(4)]
    rows = []
    for words in base:
        for edits in range(0, len(words) // 7, max(1, len(words) // 40)):
            new = list(words)
            for k in rng.sample(range(len(new)), edits):
                new[k] = "net" + str(rng.randrange(99))
            rows.append((len(rows), " ".join(new)))
    df = spark.createDataFrame(rows, "para_id bigint, text string")
    got = [(r[0], r[1]) for r in near_duplicates.expand_pairs(df, near_duplicates.similar_classes(df, width=3, least=0.6, min_words=8)).collect()]
    want = brute_pairs(rows, 3, 0.6, 8)
    assert len(got) == len(set(got)) and set(got) == want and 50 < len(want) < len(rows) * (len(rows) - 1) / 2


def test_sketches_differ_in_no_more_bits_than_their_sets():
    rng = np.random.default_rng(7)
    key = rng.integers(0, 1 << 58, 300, dtype=np.uint64)
    sets = [np.sort(rng.choice(key, n, replace=False)) for n in (1, 5, 40, 150, 260, 300)]
    text = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    sketch = near_duplicates._sketches(text, np.concatenate(sets), len(sets))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert np.bitwise_count(sketch[i] ^ sketch[j]).sum() <= len(np.setxor1d(x, y))


def test_different_texts_of_one_hash_are_told_apart(spark):
    df = spark.createDataFrame([(1, SENTENCE), (2, "other")], "para_id bigint, text string")
    first = df.select(near_duplicates.class_of(F.col("text"))).collect()
    again = df.select(near_duplicates.class_of(F.col("text"), (first[0][0],))).collect()
    assert again[0] != first[0] and again[1] == first[1]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.id: r.root for r in near_duplicates.components(links).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
    assert near_duplicates.components(links.where("false")).count() == 0


# Problem 4

SAMPLES = {
    "en": SENTENCE, "fr": "Le ministère de la santé a visité des écoles dans les villages depuis la pluie.", "es": "El ministerio de salud visitó las escuelas en los pueblos después de la lluvia.",
    "pt": "O ministério da saúde não visitou as escolas nas aldeias depois das chuvas.", "id": "Kementerian kesehatan di desa ini tidak dapat memperkuat bantuan untuk ibu dan anak.",
    "ar": "قامت وزارة الصحة في القرية بزيارة المدارس خلال عام من أجل تحسين التغذية.", "th": "ที่ประชุมใน Kandor ตกลงให้ คณะกรรมการ ดูแล สุขาภิบาล เป็นเวลา 22 เดือน ข้อมูลจาก Tubo แสดงว่า โภชนาการ ต้องใช้งบประมาณ 73 ล้านบาท ที่ Pimar มี 40 แห่ง",
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    rows = [(lang, " ".join(rng.sample(t.split(), len(t.split()))) + ". " + t) for lang, t in SAMPLES.items() for _ in range(30)]
    return language.fit(rows + [("fr", SENTENCE)] * 20)


def test_labels_are_read_in_all_spellings(spark):
    df = spark.createDataFrame([("en-GB",), ("ENG",), ("Thai",), ("es-GT",), ("und",), ("",), (None,), ("xx",)], "l string")
    got = [r[0] for r in df.select(language.label_language(F.col("l"))).collect()]
    assert got == ["en", "en", "th", "es", None, None, None, None]


def test_stretches_and_missing_labels(spark, model):
    mixed = f"{SAMPLES['en']} {SAMPLES['en']} {SAMPLES['fr']} {SAMPLES['fr']}"
    df = frame(spark, [mixed, SAMPLES["es"], None, "", "  ", f"{SAMPLES['pt']} {SAMPLES['pt']}", SAMPLES["th"], "123 456"], lang="zz", kind="q")
    rows = language.language_stretches(df, model).collect()
    assert [(r.lang, r.sentences) for r in rows if r.para_id == 1] == [("en", 2), ("fr", 2)]
    assert not [r for r in rows if r.para_id in (3, 4, 5)] and {r.lang for r in rows if r.para_id == 8} == {"und"}
    labels = spark.createDataFrame([(1, "English"), (1, "English"), (2, "en"), (7, "und")], "para_id bigint, lang_label string")
    found = {(r.para_id, r.lang) for r in language.unnamed_languages(language.language_stretches(df, model), labels).collect()}
    assert found == {(1, "fr"), (6, "pt"), (7, "th")}
    assert language.language_stretches(df.where("false"), model).count() == 0


def test_length_of_unmarked_sentences_is_learnt():
    rng = random.Random(1)
    sentence = lambda: "ก" * rng.randrange(54, 67)
    texts = [SENTENCE + " " + " ".join(sentence() for _ in range(rng.randrange(1, 5))) + " " + SENTENCE for _ in range(40)]
    assert 55 <= language.unmarked_length(texts) <= 66
    assert language.unmarked_length(texts[:3]) == language.UNMARKED


def test_confidences_hold_on_other_sentences(model):
    rng = random.Random(11)
    sentences, labels = [], []
    for lang, text in SAMPLES.items():
        words = [w.lower() for w in language.LETTERS.findall(text)]
        for _ in range(60):
            sentences.append(rng.sample(words, min(len(words), rng.randrange(4, 9))))
            labels.append(language.LANGUAGES.index(lang))
    p = model.probabilities(sentences)
    right, top = p.argmax(1) == np.array(labels), p.max(1)
    assert right.mean() > 0.9 and abs(right.mean() - top.mean()) < 0.1  # as sure as it is right
    assert right[top >= 0.9].mean() > 0.97 and (top >= model.limit)[right].mean() > 0.95


def test_wrong_training_labels_do_not_win(model):
    assert model.accuracy > 0.95
    p = model.probabilities([[w.lower() for w in re.findall(r"[^\W\d_]+", SENTENCE)]])
    assert language.LANGUAGES[p.argmax()] == "en"


# Problem 1

def noise_model():
    counts = collections.Counter({w: 500 for w in WORDS} | {"short": 400, "term": 400, "short-term": 300, "pufendora": 200, "interim": 300, "women": 300, "received": 300, "long": 300})
    rows, inner, outer = scan_noise.skip_grams([" ".join(WORDS)] * 5, counts)
    return scan_noise.NoiseModel(dict(counts), rows, inner, outer, 5, 50_000)


def test_noise_and_its_repair():
    m = noise_model()
    got = scan_noise.read("The ministry in Pufend-\nora receivcd short-\nterm health\nPage 17 of 28\nand mterim wornen found supply", m)
    assert got.kinds == {"hyphen", "chars", "pageno"}
    assert scan_noise.reflow(got.text) == "The ministry in Pufendora received short-term health and interim women found supply"
    assert scan_noise.read("The ministry of health\nreviewed short-\nterm clinics", m).kinds == set()
    assert scan_noise.read("The mini¬\r\nstry of health", m).kinds == {"hyphen"}
    assert scan_noise.read("The ministry reecived clinics", m).kinds == set()  # letters swapped, not misread


@pytest.mark.parametrize("line, page", [("- 3 -", True), ("p. 12", True), ("[9]", True), ("Page 4", True), ("7/9", True), ("29 | P a g e", True), ("xii", True), ("14", True),
                                        ("14 wards.", False), ("in 2019.", False), ("since 9", False), ("", False)])
def test_page_lines(line, page):
    assert scan_noise.is_page_line(line) is page


@pytest.mark.parametrize("line, same", [("DIGITAL FLOODING CONSULTATIONS PROFILE 7", True), ("12   Digital Flooding Consultations Profile", True), ("Digital Flooding Consultations...", True),
                                        ("Digital Flooding Consultations Profile  |  RAK", True), ("Kandor Health Desk", False), ("Digital", False)])
def test_titles(line, same):
    assert scan_noise.repeats_title(line, "Digital Flooding Consultations Profile 2019") is same


def test_scan_tables(spark):
    body = "The ministry of health reviewed the clinics\n{}\nand found that supply had improved since the rains."
    rows = [(1, "document_2019-01-01_ABC-1.pdf", body.format("DIGITAL NETS REPORT")), (2, "x", body.format("DIGITAL NETS REPORT")), (3, "document_2019-01-01_ABC-1.pdf", None),
            (4, "document_2019-01-01_ABC-1.pdf", ""), (5, "document_2019-01-01_ABC-1.pdf", body.format("- 7 -"))] + [(i, "y", SENTENCE) for i in range(6, 40)]
    df = spark.createDataFrame(rows, "para_id bigint, filename string, text string").withColumn("kind", F.lit("clash"))
    files = spark.createDataFrame([("document_2019-01-01_ABC-1.pdf", "Digital Nets Report 2019")] * 2 + [("x", None)], "filename string, title string")
    m = scan_noise.fit(df)
    found = scan_noise.signs(df, m)
    titles = scan_noise.headers(found, files, df)
    assert [(r.para_id, r.line_no) for r in titles.collect()] == [(1, 1)]
    assert {(r.para_id, r.kind) for r in found.where("kind <> 'maybe_header'").collect()} == {(5, "pageno")}
    fixed = {r.para_id: (r.text, r.kinds) for r in scan_noise.repaired(df, m, titles).collect()}
    assert "DIGITAL" not in fixed[1][0] and fixed[1][1] == ["header"] and "DIGITAL" in fixed[2][0] and fixed[3] == (None, []) and len(fixed) == len(rows)
    assert scan_noise.signs(df.where("false"), scan_noise.fit(df.where("false"))).count() == 0


def test_vectors_are_learnt_from_every_text(spark, monkeypatch):
    monkeypatch.setattr(scan_noise, "CONTEXT_WORDS", 6)  # most words are beyond the context words
    texts = ["the net and bed stood near the pump", "of the well or nurse came to the ward"] * 40 + ["y" * 100_000 + " the zinc and bed stood" + " the zinc and bed stood" * 9]
    df = frame(spark, texts).repartition(3)
    m = scan_noise.fit(df)
    rows, inner, outer = scan_noise.skip_grams(texts, {w: n for w, n in m.counts.items() if n >= m.frequent})
    assert m.rows == rows and "zinc" in rows and len(m.outer) == 6 < len(m.rows) == len(m.inner)
    assert np.allclose(m.inner, inner, atol=1e-3) and np.allclose(m.outer, outer, atol=1e-3)
    assert m.evidence("zinc", ["the", "and"]) > m.evidence("nurse", ["the", "and"])


def test_context_decides_between_a_word_and_its_misreading(spark):
    rng = random.Random(2)
    fire = "brigade smoke alarm burned forest flames".split()
    tire = "wheel axle puncture rubber garage car".split()
    texts = [" ".join(rng.sample(fire, 3) + ["fire"] + rng.sample(fire, 3)) for _ in range(600)]
    texts += [" ".join(rng.sample(tire, 3) + ["tire"] + rng.sample(tire, 3)) for _ in range(100)]
    texts += [" ".join(rng.sample(fire, 3) + ["tire"] + rng.sample(fire, 3)) for _ in range(10)]  # an f misread as t
    m = scan_noise.fit(frame(spark, texts))
    read = [(t.split()[:3] + t.split()[4:], m.correct("tire", t.split()[:3] + t.split()[4:])) for t in texts if t.split()[3] == "tire"]
    assert [true for _, true in read] == [None] * 100 + ["fire"] * 10
    blind = scan_noise.NoiseModel(m.counts, m.rows, m.inner * 0, m.outer * 0, m.frequent, m.most)
    assert {blind.correct("tire", context) for context, _ in read} == {None}  # the counts alone tell none


def test_planted_misreadings_are_repaired(spark):
    """Held-out accuracy: misreadings planted in words of texts that the model has not seen."""
    rng = random.Random(12)
    words = "ministry health supply improved district reviewed clinics vendors nurses planning integrated ownership equipped percent between teachers records coverage".split()
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(400)]
    m = scan_noise.fit(frame(spark, texts))
    right = wrong = 0
    for _ in range(300):
        text = [rng.choice(words) for _ in range(12)]
        k = rng.randrange(12)
        options = [(true, seen) for true, seen in scan_noise.GLYPHS if true in text[k] and seen.isalpha()]
        true, seen = rng.choice(options)
        misread = list(text)
        misread[k] = text[k].replace(true, seen, 1)
        got = scan_noise.read(" ".join(misread), m).text.split()
        right += got == text
        wrong += got != text and got != misread
    assert right >= 0.98 * 300 and wrong <= 3


def test_lines_of_a_hot_file_meet_its_title(spark, monkeypatch):
    monkeypatch.setattr(scan_noise, "HOT_FILES", 2)
    rows = [(i, "document_2019-01-01_ABC-1.pdf" if i < 8 else f"document_2019-01-01_ABC-{i}.pdf", "maybe_header", 1, "DIGITAL NETS REPORT") for i in range(12)]
    found = spark.createDataFrame(rows, scan_noise.SIGNS)
    files = spark.createDataFrame([(r[1], "Digital Nets Report 2019") for r in rows], "filename string, title string")
    got = scan_noise.headers(found, files, found.select("filename"))
    assert sorted(r.para_id for r in got.collect()) == list(range(12))


# Problem 9

def test_leaks_by_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [w + str(i) for w in WORDS for i in range(20)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(10, 60))] for _ in range(25)]
    docs = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        if i % 3 == 0:
            item = rng.choice(items)
            n = rng.randrange(5, 30)
            a = rng.randrange(max(1, len(item) - n))
            words[len(words) // 2:len(words) // 2] = item[a:a + n]
        docs.append((i, (" " if i % 2 else "\n").join(words).upper() if i % 5 == 0 else " ".join(words)))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"key": F.lit(1), "run": F.lit(2)})
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None)], "item_id bigint, text string")
    index = leaks.fit(d, t)
    got = {(r.doc_id, r.item_id) for r in leaks.search(d, index).collect()}
    runs = collections.defaultdict(set)
    for i, w in enumerate(items):
        for k in range(len(w) - 11):
            runs[tuple(w[k:k + 12])].add(i)
    want = set()
    for i, text in docs:
        w = (text or "").lower().split()
        want |= {(i, j) for k in range(len(w) - 11) for j in runs.get(tuple(w[k:k + 12]), ())}
    assert got == want and len(want) > 10 and index.recall > 0.99
    full = {(r.doc_id, r.item_id): r.run for r in leaks.search(d, index, paraphrases=True).collect()}
    assert all(full[p] >= 12 for p in got)
    assert leaks.search(d.where("false"), index).count() == 0


def test_shared_runs_passages_and_answers_all_count(spark):
    words = [f"{w}{i}" for i in range(20) for w in WORDS]
    items = [(1, " ".join(words[:192])), (2, "Which one is it? A) blue pumps B) red wells"), (3, " ".join(words[200:230]))]
    part = words[48:72]
    part[8], part[16] = "other", "words"
    docs = [(1, " ".join(part)), (2, "it says which one it is: red wells, or blue pumps"), (3, "so " + " ".join(words[210:222])), (4, "it says which one it is: red wells")]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    index = leaks.fit(d, t)
    index.limit = 0.2
    assert {(r.doc_id, r.item_id) for r in leaks.search(d, index, paraphrases=True).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert {(r.doc_id, r.item_id) for r in leaks.search(d, index).collect()} == {(3, 3)}
    index.limit = 2.0  # nothing is retrieved, so nothing is found
    assert not leaks.search(d, index).count() and not leaks.search(d, index, paraphrases=True).count()


def test_too_many_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_WORDS", 50)
    t = spark.createDataFrame([(i, " ".join(WORDS)) for i in range(4)], "item_id bigint, text string")
    with pytest.raises(ValueError, match="words of items"):
        leaks.fit(spark.createDataFrame([(1, SENTENCE)], "doc_id bigint, text string"), t)


def test_paraphrases_of_held_out_passages_are_retrieved(spark):
    rng = random.Random(4)
    words = [w + str(i) for i in range(40) for w in WORDS]
    items = [[rng.choice(words) for _ in range(48)] for _ in range(60)]
    docs = []
    for i, item in enumerate(items):
        part = list(item)
        for k in range(5, 48, 6):  # every sixth word is another: no run of 12
            part[k] = rng.choice(words)
        filler = [rng.choice(words) for _ in range(80)]
        docs.append((i, " ".join(filler[:40] + part + filler[40:])))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.search(d, leaks.fit(d, t), paraphrases=True).collect()}
    assert got == {(i, i) for i in range(60)} and not leaks.search(d, leaks.fit(d, t)).count()


def test_common_subsequence():
    assert leaks._lcs(np.array([1, 2, 3, 4]), np.array([2, 9, 4])) == 2 and leaks._longest_run(np.array([1, 2, 3, 4]), np.array([9, 2, 3, 8])) == 2


# Problem 10

PEOPLE = personal.learn_names(["Name: Ilka Gobarez", "said Ilka Tamarez, a", "Mrs Ilka Sonarez signed", "Dr. Osric Pomarez can", "Mrs Osric Bularez signed", "Contact: Osric Vonarez, tel."] * 3)
CASES = [
    ("Send to info@mission.test or ILKA.G+news@net.kv.example.", {("email", "info@mission.test"), ("email", "ILKA.G+news@net.kv.example")}),
    ("Write at osric_p at health-desk [dot] example now, cost at 7082.5 per visit; follow @health_desk", {("email", "osric_p at health-desk [dot] example")}),
    ("Send to lumira.t at health-desk.example, which cost at 20.5 at Kandor. Then", {("email", "lumira.t at health-desk.example")}),
    ("Write to Ilka Dobarez at fenna.pukosar@net.kv.example or Ilka Dobarez at fenna.pukosar at post [dot] invalid", {
        ("name", "Ilka Dobarez"), ("email", "fenna.pukosar@net.kv.example"), ("email", "fenna.pukosar at post [dot] invalid")}),
    ("Ask a(at)post.invalid", {("email", "a(at)post.invalid")}),
    ("Ring +44 7700 900474 or (225) 555-0138, 020 7946 0510, 00999 71/826984, 881.555.0147, +999614446085.", {
        ("phone", x) for x in ("+44 7700 900474", "(225) 555-0138", "020 7946 0510", "00999 71/826984", "881.555.0147", "+999614446085")}),
    ("ISBN 978-0-00-157111-0, lots 6869-7667, award no. 7200-AA-11-00005, at 116.3722, -07.4296 on 26-24-2020", set()),
    ("Her passport (JD-186239-C) and social security number 000-31-2100 and ID: 9968 0539 1287", {("id", "JD-186239-C"), ("id", "000-31-2100"), ("id", "9968 0539 1287")}),
    ("Deliver to Flat 6, 153 Sangogili Avenue, Paveren. Then", {("addr", "Flat 6, 153 Sangogili Avenue, Paveren")}),
    ("Address: 97 Setan Way\nKifobara 66936.", {("addr", "97 Setan Way\nKifobara 66936")}),
    ("Address: 97 Setan Way\nHeavy rains fell.", {("addr", "97 Setan Way")}),
    ("déposés au 284, rue du Marché, 68888 Kugeshora. en Calle del Sol 153, 68633 Nembara", {("addr", "284, rue du Marché, 68888 Kugeshora"), ("addr", "Calle del Sol 153, 68633 Nembara")}),
    ("Mrs Ilka Dobarez met OSRIC K. DULAREZ and O. Tamarez-Pomarez; Gobarez,\nIlka wrote.", {("name", "Ilka Dobarez"), ("name", "OSRIC K. DULAREZ"), ("name", "O. Tamarez-Pomarez"), ("name", "Gobarez,\nIlka")}),
    ("The Kosan Street Clinic and the Nokatara Bay Hospital share 94 beds. Upper Renonan.", set()),
    ("", set()),
]


@pytest.mark.parametrize("text, want", CASES)
def test_personal_information(text, want):
    assert {(k, text[a:b]) for a, b, k in personal.find(text, PEOPLE)} == want


SECRET = personal.Surrogates(b"k", PEOPLE.given)


def test_placeholders_and_surrogates():
    text = "Ilka Dobarez (info@mission.test) and Ilka Dobarez, +44 7700 900474, ID: 9968 0539 1287."
    assert personal.placeholders(text, PEOPLE) == "[NAME_1] ([EMAIL_1]) and [NAME_1], [PHONE_1], ID: [ID_1]."
    new = personal.with_surrogates(text, PEOPLE, SECRET)
    assert "Dobarez" not in new and "900474" not in new and re.search(r"\+\d\d \d{4} \d{6}, ID: \d{4} \d{4} \d{4}\.", new)
    names = re.findall(r"[A-Z]\w+ [A-Z]\w+", new)
    other = personal.with_surrogates(text, PEOPLE, personal.Surrogates(b"other", PEOPLE.given))
    assert names[0] == names[1] and new == personal.with_surrogates(text, PEOPLE, SECRET) != other
    # the words of a domain go too, its last part stays; a given name keeps its gender
    assert "mission" not in new and ".test" in new and names[0].split()[0].endswith("a") and not SECRET.word("osric").endswith("a")


def test_surrogates_hold_over_the_corpus(spark, monkeypatch):
    rng = random.Random(8)
    family = sorted({"".join(rng.choice("bdgklmnprstvz") + rng.choice("aeiou") for _ in range(2)) + "arez" for _ in range(300)})
    texts = [f"Mrs Ilka {f.capitalize()} wrote to {f}@post.invalid" for f in family] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(personal, "SYLLABLES", 2)  # so few made-up words that some meet
    few = personal.Surrogates(b"k", PEOPLE.given, 2)
    assert len({few.word(f) for f in family}) < len(family)
    monkeypatch.setattr(personal.Surrogates.__init__, "__defaults__", (2, *personal.Surrogates.__init__.__defaults__[1:]))
    made = personal.fit_surrogates(df, PEOPLE, "k")
    assert made.salts and len({made.word(f) for f in family}) == len(family)  # distinct, whatever the document
    out = {r.doc_id: r.text for r in personal.replaced(df, PEOPLE, surrogates=made).collect()}
    for i, f in enumerate(family):  # and the same in a name and in a mail address
        assert out[i] == f"Mrs {made.word('ilka').capitalize()} {made.word(f).capitalize()} wrote to {made.word(f)}@{made.word('post')}.invalid"
    assert not personal.fit_surrogates(df.where("false"), PEOPLE, "k").salts


def test_entities_are_what_is_found(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "doc_id bigint, text string").withColumns({"start": F.lit(1), "kind": F.lit(2)})
    rows = personal.entities(df, PEOPLE).collect()
    assert all(CASES[r.doc_id][0][r.start:r.end] == r.val for r in rows)
    found = {tuple(r) for r in personal.found_values(df, PEOPLE).collect()}
    assert {(r.doc_id, r.kind, r.val) for r in rows} == found == {(i, *x) for i, (_, want) in enumerate(CASES) for x in want}


def test_number_replacement_is_a_permutation():
    for n in (1, 2, 3):
        every = [str(i).zfill(n) for i in range(10 ** n)]
        assert sorted(personal.permute_digits(d, b"k") for d in every) == every


def test_values_far_from_their_signs_are_found_whole():
    local = "a" * 400
    text = "Passport" + " number" * 40 + f" {local}@post.invalid at 5 " + "X" * 200 + " Street, " + "Y" * 200 + ". Then"
    got = {(k, text[a:b]) for a, b, k in personal.find(text, PEOPLE)}
    assert got == {("email", f"{local}@post.invalid"), ("addr", "5 " + "X" * 200 + " Street, " + "Y" * 200)}


def test_personal_tables(spark):
    rows = [(1, (CASES[0][0] + " ") * 2), (2, None), (3, ""), (4, (CASES[0][0] + " ") * 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"kind": F.lit(1), "val": F.lit(2)})
    got = [tuple(r) for r in personal.found_values(df, PEOPLE).collect()]
    assert len(got) == len(set(got)) == 4
    out = {r.doc_id: r.text for r in personal.replaced(df, PEOPLE).collect()}
    assert out[2] is None and out[3] == "" and out[1] == out[4]
    assert personal.found_values(df.where("false"), personal.fit(df.where("false"))).count() == 0


def test_rare_names_of_a_large_corpus_are_learnt(spark):
    texts = ["Then reimburse Ilka Gobarez for it."] * 1500 + ["Stocks of nets fell."] * 6500
    texts[3000] = texts[6000] = "Mrs Tovin Dokiov signed."
    texts[7000] = "x" * 100_000 + " said Osric Pomarez, said Osric Pomarez"
    texts += ["Later O. Maliov and Tovin Sabalet met", "Later Osric Sabalet came"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = personal.found_values(df, personal.fit(df)).where("doc_id >= 8000").collect()
    assert {(r.doc_id, r.val) for r in got} == {(8000, "O. Maliov"), (8000, "Tovin Sabalet"), (8001, "Osric Sabalet")}


def test_sightings_summed_by_tasks_are_those_of_one_list(spark, monkeypatch):
    texts = ["Name: Ilka Gobarez", "said Ilka Tamarez, a", "Mrs Osric Bularez met Ilka", "Dr. Osric Pomarez can"] * 5
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert personal.fit(df) == personal.learn_names(texts)
    seen = [b for b in personal._count_sightings(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))]
    monkeypatch.setattr(personal, "FLUSH", 3)
    often = [b for b in personal._count_sightings(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))]
    total = lambda batches: sum((collections.Counter({(r["kind"], r["term"], r["cued"]): r["n"]}) for b in batches for r in b.to_pylist()), collections.Counter())
    assert len(often) > 1 and total(often) == total(seen)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(max_size=200))
def test_any_text_is_survived(text):
    text_quality.statistics(text)
    personal.with_surrogates(text, PEOPLE, SECRET)
    scan_noise.read(text, noise_model())
    language.sentence_spans(text)
    assert math.isfinite(text_quality.statistics(text)[3])
