import zlib

import zstandard

from siftspark.llm import langid
from siftspark.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.op1_langid(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
    sure = [r for r in held if r.accepted]
    assert len(sure) >= 0.97 * len(held) and sum(r.lang_pred == want[r.doc_id] for r in sure) >= 0.99 * len(sure)


def test_labels_sources_and_held_out_texts_teach_nothing(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").limit(300).drop("source")
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.op1_langid(docs).collect()}
    wrong = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 3 = 1, 'xx', lang) AS lang")
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.op1_langid(wrong).collect()} == plain


def test_edges(spark):
    en, fr = "the cat and the dog are in the house of the man " * 20, "le chat et le chien sont dans la maison de la femme " * 20
    rows = [(1, en, "en"), (1, en, "en"), (6, fr, "fr"), (7, None, "en"), (8, "", None), (9, "12 34 !?", "en"), (None, fr, "fr"), (10, en * 500, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = sorted(((r.doc_id, r.lang_pred, r.accepted) for r in langid.op1_langid(df).collect()), key=str)
    want = [(1, "en", True), (1, "en", True), (6, "fr", True), (7, "und", False), (8, "und", False), (9, "und", False), (None, "fr", True), (10, "en", True)]
    assert got == sorted(want, key=str)
    assert langid.op1_langid(df.limit(0)).collect() == []
    blank = df.selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r.lang_pred for r in langid.op1_langid(blank).collect()} == {"und"}


def test_predictions_against_a_plain_loop(spark):
    """Every row of the table, one compressor call at a time."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.collect()
    taught = [r for r in rows if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    learned = langid.learn(spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in taught], "doc_id long, text string, lang string"))
    assert sorted(lang for lang, _ in learned) == sorted({r.lang for r in taught})
    for lang, data in learned:  # whole texts of rows of the language, as many as fit
        parts = data.decode().split("\n")
        assert set(parts) <= {langid.letters(r.text) for r in taught if r.lang == lang}
        assert len(parts) <= langid.SAMPLE_ROWS and len(data) <= langid.DICTIONARY
    got = {r.doc_id: (r.lang_pred, round(r.score, 9), r.accepted) for r in langid.op1_langid(docs).collect()}
    coders = []
    for lang, data in learned:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        coders.append((lang, d))
    for r in rows:
        text = " ".join("".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()).encode()
        want = ("und", 0.0, False)
        if text:
            sizes = []
            for lang, d in coders:
                size = 0
                for i in range(0, len(text), 4096):
                    c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
                    size += len(c.compress(text[i : i + 4096]))
                sizes.append((size, lang))
            order = sorted(range(len(sizes)), key=lambda i: (sizes[i][0], i))
            best, second = sizes[order[0]][0], sizes[order[1]][0]
            gap = (second - best) / best
            want = (sizes[order[0]][1], round(gap / (gap + 0.01), 9), gap >= 0.01)
        assert got[r.doc_id] == want, r.doc_id


def test_sample_takes_whole_texts_and_the_shortest_if_none_fits():
    assert langid.sample([(1, 50), (2, 5), (3, 6), (4, 90)], 100) == [2, 3, 1]
    assert langid.sample([(1, 500), (2, 300)], 100) == [2]


def test_long_texts_alone_still_teach_and_digits_that_look_like_letters_do_not_count(spark):
    long = {"en": "the cat and the dog are in the house of the man " * 400, "fr": "le chat et le chien sont dans la maison de la femme " * 400}
    rows = [(i, t, lang) for i, (lang, t) in enumerate(long.items())]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dictionary=1000)
    assert {lang: len(d) > 10_000 for lang, d in learned} == {"en": True, "fr": True}
    assert langid.Classifier(learned)("\u00b2 12", 0.01) == ("und", 0.0, False)


def test_accepted_rows_keep_columns_of_any_name(spark):
    en = "the cat and the dog are in the house of the man " * 20
    fr = "le chat et le chien sont dans la maison de la femme " * 20
    learned = langid.learn(spark.createDataFrame([(1, en, "en"), (2, fr, "fr")], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, en, 77.0, "mine", 0, "r"), (3, None, 1.0, "x", 1, "s")], "doc_id long, text string, score double, lang_pred string, accepted int, row string")
    kept = langid.accepted_rows(df, learned)
    assert kept.columns == df.columns
    assert [tuple(r) for r in kept.collect()] == [(1, en, 77.0, "mine", 0, "r")]
