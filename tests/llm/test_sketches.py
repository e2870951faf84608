import datetime as dt
import random

from quadloom.llm import sketches

SCHEMA = "s_lex string, o_lex string, p_lex string, g_iri string, added_at timestamp, slot int, rank int"


def rows(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        day = None if r.random() < 0.1 else dt.datetime(2024, 1, r.randrange(1, 4), 5)
        g = None if r.random() < 0.1 else r.choice(["g1", "g2"])
        out.append((f"s{r.randrange(3000)}", None if r.random() < 0.05 else f"o{r.randrange(40)}", "hot" if r.random() < 0.6 else "p", g, day, 1, 2))
    return out


def test_estimates_are_within_the_error(spark):
    data = rows(20000, 1)
    got = sketches.estimates(sketches.registers(spark.createDataFrame(data, SCHEMA))).collect()
    for r in got:
        keys = r.grouping.split("+") if r.grouping != "all" else []
        mine = [x for x in data if all((x[4].date() if x[4] else None, x[3], x[2])[("day", "g_iri", "p_lex").index(k)] == r[k] for k in keys)]
        for est, true in ((r.n_subjects, len({x[0] for x in mine})), (r.n_objects, len({x[1] for x in mine} - {None}))):
            assert abs(est - true) <= max(1, 5 * r.std_error * true), (r, true)
    groups = {tuple((x[4].date() if x[4] else None, x[3], x[2])) for x in data}
    assert sum(r.grouping == "day+g_iri+p_lex" for r in got) == len(groups)
    assert sum(r.grouping == "all" for r in got) == 1


def test_merge_of_overlapping_parts_equals_the_whole(spark):
    data = rows(3000, 2)
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    whole = {(r.day, r.g_iri, r.p_lex, *r.codes) for r in sketches.registers(df(data)).collect()}
    merged = sketches.merge(sketches.registers(df(data[:2000])), sketches.registers(df(data[1000:])), sketches.registers(df([])))
    assert {(r.day, r.g_iri, r.p_lex, *r.codes) for r in merged.collect()} == whole


def test_empty(spark):
    assert sketches.estimates(sketches.registers(spark.createDataFrame([], SCHEMA))).collect() == []
