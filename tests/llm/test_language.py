import random

from quadloom.llm import language
from quadloom.llm.queries import _records
from quadloom.runtime import table

SF = "/root/testdata/sf0.01"


def model(spark):
    return language.fit_table(table(spark, SF, "language_samples"), _records(spark, SF))


def test_held_out_accuracy(spark):
    rows = [(r.lang, r.sample_text) for r in table(spark, SF, "language_samples").orderBy("sample_id").collect()]
    train, test = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    m = language.fit(train)
    right = sum(len(f) == 1 and f[0][2] == lang for (lang, _), f in zip(test, m.segments([x for _, x in test])))
    assert right >= 0.97 * len(test)


def test_changes_within_a_text_are_found(spark):
    m = model(spark)
    rows = [(r.lang, r.sample_text) for r in table(spark, SF, "language_samples").orderBy("sample_id").collect()]
    r, good, n = random.Random(1), 0, 0
    for _ in range(300):
        (a, x), (b, y) = r.sample(rows, 2)
        if a != b:
            n += 1
            f = m.segments([x + r.choice([" / ", ". ", " ", "\n", " ("]) + y])[0]
            good += [s[2] for s in f] == [a, b]
    assert good >= 0.95 * n


def test_what_is_no_prose_has_no_language(spark):
    m = model(spark)
    texts = ["", None, "urn:x:shelf/A12", "MS 123.45", "63627/811", "758.6 kg, fol. 12", "“ex libris”", "word", "[77999], inv. 3", "http://a.b/the-small-museum-keeps"]
    assert all(not f for f in m.segments(texts))


def test_altered_characters_do_not_matter(spark):
    m = model(spark)
    base = "The small museum keeps the letters of the mill"
    for x in (base, base.upper(), base.swapcase(), base.replace("e", "е").replace("o", "о"), "".join(chr(ord(c) + 0xFEE0) if c != " " else "　" for c in base), base.replace("m", "m​"), f"<p>{base}</p> #123"):
        f = m.segments([x])[0]
        assert [s[2] for s in f] == ["en"], x
        assert x[f[0][0] : f[0][1]].strip("<p>") and 0 <= f[0][0] < f[0][1] <= len(x)


def test_long_titles_and_short_words(spark):
    m = model(spark)
    base = "The small museum keeps the letters of the mill"
    title = "Das kleine Museum bewahrt die Briefe aus der alten Mühle am Fluss und zeigt sie jedem Gast " * 8
    for a, b in ("“”", '""', "«»", "„“", "‹›", "<>"):
        assert [x[2] for x in m.segments([f"{base} {a}{title}{b} {base}"])[0]] == ["en"], a
    assert language.clauses("e o; x")[0] == [("e o", 0)]


def test_drawn_texts_are_the_first_by_hash(spark):
    from pyspark.sql import functions as F

    rows = [("en", f"text number {i % 700}" if i % 3 else "one text that a third of the rows hold") for i in range(30_000)] + [("de", f"Satz {i}") for i in range(7)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = [(r.lang, r.text) for r in language._draw(df, 40)]
    hashed = df.distinct().withColumn("h", F.xxhash64("text")).collect()
    want = [(lang, r.text) for lang in ("de", "en") for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: r.h)[:40]]
    assert got == want


def test_an_unknown_language_is_refused(spark):
    import pytest

    df = spark.createDataFrame([(1, "xx", "some words of it")], "sample_id bigint, lang string, sample_text string")
    with pytest.raises(ValueError):
        language.fit_table(df)


def test_scores_are_those_of_the_presence_kernel(spark):
    m = language.fit([("en", "the mill and the museum"), ("de", "die Mühle und das Museum")])
    words = ["the", "the", "museum"]
    grams = set().union(*map(language._grams, words))
    unknown = sum(sum(g not in m.index for g in language._grams(w)) for w in words)
    known = [m.index[g] for g in grams if g in m.index]
    want = m.weights[known].sum(0) / (len(known) + unknown) ** 0.5
    assert abs(m.scores([words, ["mill"]])[0] - want).max() < 1e-5


def test_labels(spark):
    labels = {"en": "en", "EN": "en", "eng": "en", "en-US": "en", "en_GB": "en", "e": None, "english": None, "": None, None: None, "und": None, "x-none": None, "-": None, "deu-x": "de", "ger": None}
    df = spark.createDataFrame([(k,) for k in labels], "l string")
    got = {r.l: r.n for r in df.select("l", language.named(df["l"]).alias("n")).collect()}
    assert got == labels


def test_segments_table(spark):
    m = model(spark)
    long = " ".join(["The small museum keeps the letters of the mill."] * 3000)
    df = spark.createDataFrame([(1, "de", "The small museum keeps the letters of the mill"), (1, "en", "Das kleine Museum bewahrt die Briefe aus der Mühle"), (None, None, None), (2, "en", ""), (3, None, long)], "key int, label string, text string")
    segs = language.segments(df, "key", "text", "label", m)
    assert segs.count() == 5
    assert {tuple(r) for r in language.unnamed_languages(segs).collect()} == {(1, "en"), (1, "de"), (3, "en")}
    main = {(r.key, r.lang) for r in language.main_language(segs).collect()}
    assert main == {(1, "en"), (1, "de"), (None, None), (2, None), (3, "en")}
    assert language.segments(df.limit(0), "key", "text", "label", m).count() == 0
    assert language.fit_table(table(spark, SF, "language_samples").limit(0)).segments(["The small museum keeps"]) == [[]]


def test_short_clauses_are_searched_together(spark, monkeypatch):
    import numpy as np

    m, r = model(spark), np.random.default_rng(1)
    sizes = np.array([1, 2, 7, language._TOGETHER, language._TOGETHER + 1, 7, 1, 40])
    starts = sizes.cumsum() - sizes
    for e in (r.random((sizes.sum(), 3)) * 2, r.integers(0, 2, (sizes.sum(), 3)).astype(float)):  # the second is full of ties
        assert m.paths(e, starts, sizes) == [m.path(e[a : a + n]) for a, n in zip(starts, sizes)]
    assert m.paths(e, starts[:0], sizes[:0]) == []
    texts = ["The small museum keeps the letters of the mill das kleine Museum bewahrt die Briefe aus der Mühle", "", None, "the the the the", "ΟΔΟΣ ΤΗΣ ΠΟΛΗΣ ΚΑΙ"] * 3
    want = m.segments(texts)
    monkeypatch.setattr(language, "_CACHE", 5)  # the vocabulary is forgotten again and again
    small = language.Model(m.languages, m.index, m.weights)
    assert [small.segments([t])[0] for t in texts] == want
    monkeypatch.setattr(language.Model, "path", None)  # one clause at a time took too long
    other = language.Model(m.languages, m.index, m.weights)
    assert other.segments(texts) == want and [s[2] for s in want[0]] == ["en", "de"]


def test_words_in_lower_case():
    for clause in ("The Mill's OLD wheel_s 3x", "ΑΣ.Β ΟΔΟΣ’Σ", "İstanbul İÇ", "", "12 _ '", "ÉCOLE d’Été"):
        words = language._WORD.findall(clause)
        assert language.words_of(clause) == [w.lower() for w in (words if clause.isascii() else language._mend(words))]


def test_indicator_drops_repeats():
    import numpy as np

    x = language.Indicator(np.array([2, 0, 0, 2, 0]), np.array([1, 3, 0, 1, 3]), (4, 5))
    assert list(zip(x.rows.tolist(), x.cols.tolist())) == [(0, 0), (0, 3), (2, 1)] and x.row_sums().tolist() == [2, 0, 1, 0]
    assert (x @ np.arange(10.0).reshape(5, 2)).tolist() == [[6, 8], [0, 0], [2, 3], [0, 0]]
