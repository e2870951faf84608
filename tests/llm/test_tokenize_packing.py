import random
from collections import defaultdict

import pytest

from quadloom.llm import packing, tokenize
from quadloom.llm.queries import byte_bpe_50k

TEXTS = ["", None, " ", "a", "Hello  world\n\n\n foo's 12345", "<|endoftext|> x", "é" * 50, "\x1c\x1d \x0b\t", "🙂 naïve → 値", "a" * 5000, " " * 3000 + "x", "word " * 4000, "x1y2" * 3000, "tail  \n" * 900, "it's'll " * 700]


@pytest.mark.parametrize(("chunk", "overlap"), [(65536, 2048), (500, 60), (64, 20)])
def test_ids_equal_those_of_the_library(spark, chunk, overlap):
    tok = byte_bpe_50k()
    enc = tok.encoding()
    df = spark.createDataFrame([(i % 7 if i else None, x, "t", 3) for i, x in enumerate(TEXTS * 2)], "doc_id int, text string, ids string, n_tokens int")
    got = tokenize.encode_table(df, "doc_id", "text", tok, chunk=chunk, overlap=overlap)
    rows = sorted((str(r.doc_id), tuple(r.ids)) for r in got.collect())
    want = sorted((str(i % 7 if i else None), tuple(enc.encode_ordinary(x) if x else ())) for i, x in enumerate(TEXTS * 2))
    assert rows == want
    counts = sorted((str(r.doc_id), r.n_tokens) for r in tokenize.encode_table(df, "doc_id", "text", tok, True, chunk, overlap).collect())
    assert counts == sorted((k, len(v)) for k, v in want)
    back = sorted(r.text for r in tokenize.decode_table(got, "doc_id", "ids", tok).collect())
    assert back == sorted(x or "" for x in TEXTS * 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert tokenize.encode_table(df, "doc_id", "text", byte_bpe_50k()).count() == 0
    assert packing.pack(df.selectExpr("doc_id", "0 AS size"), "doc_id", "size", 10).count() == 0


def check(rows, sizes, capacity):
    per, total = defaultdict(list), defaultdict(int)
    for r in rows:
        per[r.container].append(r)
        total[r.item] += r.n_tokens
        assert r.piece_start == r.piece_no * capacity
    assert dict(total) == {k: v or 0 for k, v in sizes.items()}
    pieces = defaultdict(int)
    for r in rows:
        pieces[r.item] += 1
    assert all(pieces[k] == max(1, -(-(v or 0) // capacity)) for k, v in sizes.items())
    for v in per.values():
        end = 0
        for r in sorted((x for x in v if x.n_tokens), key=lambda x: x.place):
            assert r.place >= end
            end = r.place + r.n_tokens
        assert end <= capacity
    return per


def test_packing(spark):
    r = random.Random(4)
    sizes = {i: r.choice([0, None, 7, 7, 7, r.randrange(1, 100), r.randrange(1, 30), r.randrange(100, 350)]) for i in range(3000)}
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in sizes.items()], "item int, size int, container int, key string")
    rows = packing.pack(df, "item", "size", 100, group=8).collect()
    per = check(rows, sizes, 100)
    used = sum(v or 0 for v in sizes.values())
    assert len(per) <= 1.02 * used / 100 + 1
    loads = defaultdict(int)
    for x in rows:
        loads[x.step_group] += x.n_tokens
    assert max(loads.values()) - min(loads.values()) <= 2 * 100


@pytest.mark.parametrize("sizes", [[0, 0], [5], [100] * 5, [51] * 9, [1] * 250, [200, 201, 99, 1]])
def test_small_cases(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "item int, size int")
    check(packing.pack(df, "item", "size", 100).collect(), dict(enumerate(sizes)), 100)


def test_a_hot_size_is_spread(spark):
    df = spark.range(20_000).selectExpr("id AS item", "IF(id % 3 = 0, 10, int(id % 9) + 1) AS size")
    rows = packing.pack(df, "item", "size", 64).collect()
    check(rows, {r.item: r["size"] for r in df.collect()}, 64)


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None, 40), (1, 40), (1, 40), (None, 40)], "item int, size int")
    rows = packing.pack(df, "item", "size", 100).collect()
    assert len(rows) == 4 and len({(r.container, r.place) for r in rows}) == 4


def test_plan_uses_gaps_of_longer_tiers():
    patterns = packing.plan({60: 10, 40: 5, 20: 10}, 100)
    assert sum(p.containers for p in patterns) == 10
    assert packing.tier_of(60, 100) == 0 and packing.tier_of(50, 100) == 1 and packing.tier_of(25, 100) == 2
