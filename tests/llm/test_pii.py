import random

from quadloom.llm import pii

GIVEN = ["Tomas", "Ilka", "Noor", "Freya", "Piet", "Wanda"]
FAMILY = [a + b for a in ("Zan", "Quil", "Mer", "Ost") for b in ("hauzen", "stad", "molk", "vance")]


def corpus(seed=2, n=400):
    """Documents with known spans."""
    r = random.Random(seed)
    docs = []
    for i in range(n):
        parts, spans, at = [], set(), 0

        def put(text, kind=None):
            nonlocal at
            if kind:
                spans.add((kind, at, at + len(text)))
            parts.append(text)
            at += len(text)

        for _ in range(r.randrange(1, 4)):
            g, f = r.choice(GIVEN), r.choice(FAMILY)
            name = r.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} {r.choice('ABC')}. {f}", f"{g} van {f}"])
            mail = r.choice([f"{g}.{f}@example.org", f"{f}-{g[0]}@mail.example.net", f"{g[0]}{f} [at] data [dot] team [dot] example", f"{g}_{f} at post dot invalid"]).lower()
            kind = r.randrange(6)
            if kind == 0:
                put("Author: ")
                put(name, "name")
                put(" <")
                put(mail, "email")
                put(">\n")
            elif kind == 1:
                put("Participant ")
                put(name, "name")
                put(" (BSN ")
                put(f"{r.randrange(10**8, 10**9)}", "id_number")
                put(") withdrew.\nrun_id = 123456789\nOrder number 280670700\n")
            elif kind == 2:
                put("Call Monte Carlo desk, then ")
                put(name, "name")
                put(" on ")
                put(r.choice(["+44 20 7946 0102", "(555) 555-0141", "01632 960497", "+1-555-555-0171"]), "phone")
                put(".\nz = X@W.T + b@c.mean; logo = 'speed@2x.png'\n")
            elif kind == 3:
                put("Sent to ")
                put(r.choice(["Calle Larkmoor 132", "157 Rosmal Road", "Flat 2, 169 Elmsher Avenue", "91, rue du Quellen", "Ostwinlaan 92", "ul. Pellan 75/30"]), "address")
                put(", 3050 Orrin, signed by ")
                put(name, "name")
                put(". Figure 59 Road types\n")
            elif kind == 4:
                put("1\t")
                put(f"{g} {f}", "name")
                put("\t")
                put(mail, "email")
                put("\t")
                put(r.choice(["961-29-1473", "QQ 54 99 62 C", "YL8033892", "164.145.830-64", "04840640T"]), "id_number")
                put("\n")
            else:
                put("The Harbour Lights dataset; Random Forest of 300 trees; loc['289-63-289':]; isbn = '978-0-237-711859187'\n🙂 naïve\n")
        docs.append((i, "".join(parts), spans))
    return docs


def test_planted_cases(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, x, "x") for i, x, _ in docs], "doc_id int, text string, spans string")
    got = {(r.key, s.pii_kind, s.start_pos, s.end_pos) for r in pii.find(df, "doc_id", "text").collect() for s in r.spans}
    want = {(i, *s) for i, _, spans in docs for s in spans}
    assert len(got & want) >= 0.99 * len(want), sorted(want - got)[:5]
    assert len(got & want) >= 0.99 * len(got), sorted(got - want)[:5]


def test_redaction_keeps_the_rest(spark):
    docs = corpus(3, 150)
    rows = [(i, x) for i, x, _ in docs] + [(None, None), (None, ""), (1, docs[0][1]), (7, "plain " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    out = pii.redact(df, "doc_id", "text").collect()
    assert len(out) == len(rows)
    whole = "".join(r.text or "" for r in out)
    assert "@example.org" not in whole and "[EMAIL]" in whole and "[NAME]" in whole and "run_id = 123456789" in whole
    assert sum(r.text is None for r in out) == 1 and ("plain " * 20_000) in {r.text for r in out}


def test_no_candidates_and_empty(spark):
    df = spark.createDataFrame([(1, "nothing here"), (2, None), (3, "")], "doc_id int, text string")
    assert pii.find(df, "doc_id", "text").count() == 0
    assert pii.find(df.limit(0), "doc_id", "text").count() == 0
    assert pii.redact(df, "doc_id", "text").count() == 3


def test_numbers_do_not_depend_on_the_size_of_the_corpus(spark):
    text = "Call 01632 960497 now\nThen 961-29-1473\n"
    for n in (1, 19, 40):  # copies, and other texts of the same form
        rows = [(i, text if i < 3 else f"{text}{i}\n") for i in range(n)]
        got = pii.find(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text").collect()
        assert {(r.key, tuple((s.pii_kind, s.start_pos, s.end_pos) for s in r.spans)) for r in got} == {(i, (("phone", 5, 17), ("id_number", 27, 38))) for i in range(n)}


def test_own_line_outweighs_the_form(spark):
    other = [(i, f"order 961-29-{1000 + i}\n") for i in range(40)]
    mine = [(99, "order 961-29-1473 by ann@lab.example\n")]
    got = pii.find(spark.createDataFrame(other + mine, "doc_id int, text string"), "doc_id", "text").collect()
    assert {r.key: [s.pii_kind for s in r.spans] for r in got} == {99: ["id_number", "email"]}


def test_addresses_in_every_bracket_and_case():
    for x in ("john {AT} lab.example", "john <At> lab.example", "john at lab [DOT] example", "john at lab {dot} example", "john at lab (Dot) example", "john(@)lab.example".replace("(@)", " (@) "), "john at lab dot example"):
        text = f"see {x} now"
        assert [text[a:b] for a, b in pii._emails(text)] == [x], x


def test_names_with_accents_and_of_other_scripts(spark):
    texts = ["Write to José Núñez <jose.nunez@example.org> today", "Từ Nguyễn <tu.nguyen@example.org>", "Ответ: Анна Ковальчук <анна.ковальчук@пример.рф>", "the Random Forest of the Harbour Lights"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.key, s.pii_kind, texts[r.key][s.start_pos : s.end_pos]) for r in pii.find(df, "doc_id", "text").collect() for s in r.spans}
    assert {x for x in got if x[1] == "name"} == {(0, "name", "José Núñez"), (1, "name", "Từ Nguyễn"), (2, "name", "Анна Ковальчук")}
