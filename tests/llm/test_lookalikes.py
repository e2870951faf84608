import itertools
import unicodedata

from quadloom.llm import lookalikes

SCHEMA = "literal_id bigint, lex string, canonical string, look string"
SAME = [
    ["The map", "Тhе map", "Ｔｈｅ　ｍａｐ", "The map", "The m​ap", "The map­"],
    ["café", "café", "cаfé"],
    ["office", "oﬃce", "οffice"],
    ["cr\u0450me", "cr\u0435\u0300me", "cr\u00e8me"],
    ["\u03aasa", "\u0399\u0308sa", "\u00cfsa"],
    ["in-situ", "in‐situ", "in‑situ", "in－situ"],
    ["Список", "Cпиcoк"],
    ["ij", "ĳ"],
    ["A lamp", "A lamp\U000e0100", "A\u180b lamp", "A lamp\u2069"],
    ["5 K; x", "5 K; x", "5 K; x", "5 K\x01; x", "5ㅤ K; x".replace(" K", " K")],
    [""],
]
OTHER = ["the map", "cafe", "m²", "m2", "a–b", "a-b", "“x”", '"x"', "The map.", "Thе  map", "7", "٧"]


def test_pairs_and_canonical_texts(spark):
    texts = [x for g in SAME for x in g] + OTHER
    rows = [(i, x, "c", "l") for i, x in enumerate(texts + texts)] + [(900, None, "c", "l"), (None, "The map", "c", "l"), (901, "x" * 200_000, "c", "l"), (902, "x" * 199_999 + "х", "c", "l")]
    df = spark.createDataFrame(rows, SCHEMA)
    cls = {x: k for k, g in enumerate(SAME) for x in g} | {x: 100 + k for k, x in enumerate(OTHER)}
    want = {(i, j) for (i, a, *_), (j, b, *_) in itertools.combinations(rows[: 2 * len(texts)], 2) if a != b and cls[a] == cls[b]} | {(901, 902)}
    for block in (20_000, 3, 1):
        got = [tuple(r) for r in lookalikes.same_look_pairs(df, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    out = {r.literal_id: r for r in lookalikes.canonical_texts(df).collect() if r.literal_id is not None}
    assert len(out) == len(rows) - 1 and out[900].canonical is None
    for a, b in itertools.combinations([r for r in out.values() if r.literal_id < 2 * len(texts)], 2):
        assert (a.canonical == b.canonical) == (cls[a.lex] == cls[b.lex]), (a, b)
    assert out[0].canonical == "The map" and unicodedata.is_normalized("NFC", out[texts.index("café")].canonical)


def test_hot_text_and_classes(spark):
    rows = [(i, "The m\u200bap" if i % 50 else "The map", "c", "l") for i in range(3000)] + [(5000, "alone", "c", "l"), (5001, "th\u200be", "c", "l")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in lookalikes.same_look_pairs(df, block=100).collect()]
    want = {(i, j) for i in range(0, 3000, 50) for j in range(3000) if j % 50 and i < j} | {(j, i) for i in range(0, 3000, 50) for j in range(3000) if j % 50 and j < i}
    assert len(got) == len(want) and set(got) == want
    assert [tuple(r) for r in lookalikes.look_classes(df).collect()] == [("The map", 2, 3000)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lookalikes.same_look_pairs(df).count() == 0 and lookalikes.canonical_texts(df).count() == 0


def test_copies_of_texts_stay_few_and_off_the_driver(spark, tmp_path):
    rows = [(i, f"text {i}" if i % 3 else "one text that a third of the rows hold", "c", "l") for i in range(30_000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    df.groupBy("lex").count().withColumnRenamed("lex", "_lex").write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    joined = lookalikes._salted(df, texts, 64, "inner")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {(r.literal_id, r["count"]) for r in joined.collect()} == {(i, 1 if i % 3 else 10_000) for i in range(30_000)} and joined.count() == 30_000
    assert joined.select("_s").where("lex LIKE 'one%'").distinct().count() == 64
    assert lookalikes._salted(texts.select(texts["_lex"].alias("lex"), texts["count"].alias("literal_id")), texts, 64, "full").count() < 2 * texts.count()
