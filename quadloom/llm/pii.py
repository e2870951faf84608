"""Personal information in free text: where it lies, and the text with typed placeholders, by information-theoretic sanitisation.

1. One pass over the texts yields *candidates*: addresses of mail in any way of writing, and strings of a form that numbers,
   streets or names take. Each carries its *terms*: the words of a name, or the form and the cue before it. An address of mail is
   a protected entity itself, the seed of all estimates, so it needs none.
2. The corpus tells how strongly a term reveals a protected entity: its disclosure is log2(P(entity | term) / P(entity)).
   For a word, the entity is an address of mail close by that is made of the word; then words join by standing with disclosing
   ones. For forms and cues it is a line that holds an address of mail or a name; they matter where a cue names something else.
   P(entity) is the share measured over the corpus, but no more than a chance level (WORD_CHANCE, LINE_CHANCE): in a corpus full of
   persons the share would be no measure of chance, and the thresholds are then a share of hits.
3. Candidates whose terms disclose more than the thresholds are the findings; overlaps go to the stronger kind. All counts are
   over all texts; candidates are far fewer than words, so the joins move little.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.runtime import Spool, ship

#: Bits by which a word, a form or a cue must raise the odds of a protected entity.
WORD_BITS = 6.0
LINE_BITS = 3.0
#: P(entity) as measured, but no more than this: where the corpus is dense with persons, the base rate is no chance level.
WORD_CHANCE = 1 / 1024
LINE_CHANCE = 1 / 64
NEAR = 90

KINDS = ("email", "address", "phone", "id_number", "name")  # the stronger first

# Words for kinds of street, particles of names, cues of identity numbers, cues of other numbers, ends of file names.
_STREET_AFTER = "Street|Road|Lane|Avenue|Drive|Square|Terrace|Close|Court|Crescent|Gardens|Place|Way|Hill|Boulevard|Row|Mews|Parade|Walk"
_STREET_BEFORE = r"Calle|Via|Viale|Corso|Piazza|Plaza|Avenida|Paseo|Rua|Praça|Travessa|ul\.|al\.|pl\.|os\.|ул\.|Rue|Boulevard|Chemin|Place|Impasse|Am|Im|An der|Auf der|Zum|Zur"
_STREET_FRENCH = "rue|avenue|boulevard|chemin|place|allée|impasse|quai|cours|route"
_STREET_ENDING = "straße|strasse|weg|platz|allee|gasse|ring|damm|ufer|laan|straat|gracht|plein|kade|dijk|singel|gatan|vägen|gade|vej|feld"
_UNIT = r"Flat|Apt\.?|Apartment|Unit|Suite|Wohnung|bus|lgh|m\."
_PARTICLE = "van|von|de|da|di|del|della|der|den|du|dos|das|la|le|ten|ter|af|av|zu|zur|bin|ibn|al|el|y"
_ID_CUES = ("bsn", "burgerservicenummer", "ssn", "nino", "dni", "cpf", "passport", "reisepass", "insurance", "social", "tax", "personnummer", "pesel", "steuer", "sozialversicherung")
_OTHER_CUES = ("id", "uid", "key", "number", "order", "batch", "ticket", "run_id", "isbn", "seed", "version", "release", "row", "rows", "count", "epoch", "step")
_FILES = "png|jpg|jpeg|gif|svg|csv|txt|json|py|ipynb|md|html|xml|pdf|zip|gz|parquet|dat"


def _class(test) -> str:
    """Letters of the scripts that have capitals, as a set for a pattern."""
    return "".join(c for c in map(chr, (*range(0x41, 0x590), *range(0x1C90, 0x1CC0), *range(0x1E00, 0x2000))) if c.isalpha() and test(c))


_U, _L = _class(str.isupper), _class(lambda c: not c.isupper())
# The large patterns begin with a set of first characters, as the search skips to these; the rest looks behind at the one it met.
_w = rf"(?:[{_L}]+(?:['’][{_U}][{_L}]+)?|['’][{_U}][{_L}]+)(?:-[{_U}][{_L}]+)*"  # a word of a name without its first letter
_W = rf"[{_U}]{_w}"
_I = rf"[{_U}]\."
_P = rf"(?:(?:{_PARTICLE}|[Vv]an de[rn]?|de la) )"
_NAMES = re.compile(  # each capital where a name may begin; the groups are what it may be, without the capital
    rf"[{_U}](?<![\w@.\-][{_U}])"
    rf"(?:(?=(?P<c>(?P<c1>{_w}), (?:(?P<c2>{_W})(?: {_I})*|(?P<cd>{_I}(?: ?{_I})*)))(?![\w@])))?"
    rf"(?:(?=(?P<a>(?P<a1>{_w})(?: {_I})* {_P}?{_P}?(?P<a2>{_W}))(?![\w@\-])))?"
    rf"(?:(?=(?P<b>\.(?: ?{_I})* {_P}?{_P}?(?P<b2>{_W}))(?![\w@\-])))?"
)
_BEFORE_NAME = re.compile(rf"(?<![\w@.\-]){_P}{{1,2}}\Z")
_LOCAL = re.compile(r"[^\W_](?:[\w.%+-]{0,63})\Z")
_DOMAIN = re.compile(r"(?:[^\W\d_](?:[\w-]{0,61}\w)(?:\.|(?=\.)))(?:[\w-]{1,63}\.)*[^\W\d_]{2,24}(?![\w@])|[^\W\d_][\w-]{0,61}\w\.(?:[\w-]{1,63}\.)*[^\W\d_]{2,24}(?![\w-])")
_OPEN, _CLOSE = "[({<", "])}>"
_AT_WORDS, _DOT_WORDS = ("at", "AT", "At"), ("dot", "DOT", "Dot")
_AT = re.compile(rf" ?[{re.escape(_OPEN)}](?:{'|'.join(_AT_WORDS)})[{re.escape(_CLOSE)}] ?|&#64;|%40|＠| (?:at|AT|At|\(@\)|\[@\]) ")
_SPOKEN = re.compile(rf"[^\W\d_][\w-]{{0,61}}\w(?:(?: ?[{re.escape(_OPEN)}](?:{'|'.join(_DOT_WORDS)})[{re.escape(_CLOSE)}] ?| (?:{'|'.join(_DOT_WORDS)}) |\.)[\w-]{{2,63}}){{1,5}}", re.A)
# a spoken address has one of these: the at in brackets or as a code, or the dot as a word
_SIGNS = (*(b + w for b in _OPEN for w in _AT_WORDS), *(b + w for b in (*_OPEN, " ") for w in _DOT_WORDS), "&#64;", "%40", "＠", "(@)", "[@]")
_NUMBERS = re.compile(
    r"[+(0-9A-Z](?<![\w.+/=@-][+(0-9A-Z])(?:"
    r"(?P<intl>(?<=\+)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{1,6}){1,6})"
    r"|(?P<zeros>(?<=0)0\d{2}[ .-]\(?\d{1,5}\)?(?:[ .-]\d{2,7}){1,4})"
    r"|(?P<parens>(?<=\()0?\d{2,4}\) ?\d{3,4}[ .-]?\d{3,5})"
    r"|(?P<north>(?<=\d)\d{2}(?P<sep>[.-])\d{3}(?P=sep)\d{4})"
    r"|(?P<trunk>(?<=0)[1-9]\d{1,3}[ /-]\d{3,8}(?:[ -]\d{3,5})?)"
    r"|(?P<ssn>(?<=\d)\d{2}-\d{2}-\d{4})"
    r"|(?P<cpf>(?<=\d)\d{2}\.\d{3}\.\d{3}-\d{2})"
    r"|(?P<dni>(?<=\d)\d{7}-?[A-HJ-NP-TV-Z])"
    r"|(?P<nino>(?<=[A-Z])[A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D])"
    r"|(?P<passport>(?<=[A-Z])[A-Z]\d{7})"
    r"|(?P<nine>(?<=\d)\d{8})"
    r")(?![\w@+/=]|[.-]\d)"
)
_PHONES = {"intl", "zeros", "parens", "north", "trunk"}
_NO = r"\d{1,4}(?: ?[a-z](?!\w))?(?:[-/]\d{1,4})?(?:[-/]\d{1,4})?"
_S = rf"[{_U}][{_L}]+(?:[- ][{_U}][{_L}]+){{0,2}}"
_KINDS_BEFORE = "|".join(f"(?<={k[0]}){k[1:]}" for k in _STREET_BEFORE.split("|"))
_FIRST = "0-9" + _U + "".join(sorted({k[0] for k in _STREET_BEFORE.split("|") if k[0].islower()}))
_STREETS = re.compile(
    rf"[{_FIRST}](?<![\w.@/-][{_FIRST}])"
    rf"(?:(?P<after>(?<=\d)\d{{0,3}}[a-z]? {_S} (?:{_STREET_AFTER})\b)"
    rf"|(?P<french>(?<=\d)\d{{0,3}}(?: ?(?:bis|ter|quater))?,? (?:{_STREET_FRENCH}) (?:(?:du|de la|de|des|d['’]) ?)?{_S})"
    rf"|(?P<before>(?:{_KINDS_BEFORE}) {_S} {_NO}(?![\w.]\d|\w))"
    rf"|(?P<ending>(?<=[{_U}])[{_L}]+(?:{_STREET_ENDING}) {_NO}(?![\w.]\d|\w)))"
    rf"(?:,? (?:{_UNIT}) \d{{1,4}}[a-z]?\b)?"
)
_UNIT_BEFORE = re.compile(rf"(?<![\w.@/-])(?:{_UNIT}) \d{{1,4}}[a-z]?, \Z")


def _emails(text: str) -> list[tuple[int, int]]:
    """Spans of mail addresses, plain and spoken, without what surrounds them."""
    found = []
    at = text.find("@")
    while at >= 0:
        left, right = _LOCAL.search(_tail(text, at)), _DOMAIN.match(text, at + 1)
        if left and right and not re.search(rf"\.(?:{_FILES})\Z", right.group(), re.I):
            found.append((at - len(left.group()), right.end()))
        at = text.find("@", at + 1)
    for m in _AT.finditer(text) if any(x in text for x in _SIGNS) else ():
        left, right = _LOCAL.search(_tail(text, m.start())), _SPOKEN.match(text, m.end())
        spoken = m.group().isspace() or m.group().strip().isalpha()
        if left and right and (not spoken or re.search(r"\bdot\b", right.group(), re.I)):
            found.append((m.start() - len(left.group()), right.end()))
    return sorted(found)


def _tail(text: str, end: int) -> str:
    """The run of address characters before end, without leading marks."""
    start = end
    while start > 0 and end - start < 64 and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
        start -= 1
    return text[start:end].lstrip("._%+-")


_NO_LETTER = re.compile(r"[\W\d_]+")
_ENDS_LOCAL = re.compile(r" ?[\[({<]at|@|%40|&#64;| at |＠")
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "æ": "ae", "ß": "ss", "đ": "d", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})


def _folded(word: str) -> str:
    """Without accents, as addresses write names."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word.translate(_PLAIN)) if not unicodedata.combining(c))


def _matches(word: str, pieces: list[str]) -> bool:
    """Whether a piece of a mail address is the word, or an initial and the word."""
    return any(p == word or len(word) > 2 and len(p) == len(word) + 1 and p.endswith(word) for p in pieces)


def _line(text: str, at: int) -> int:
    return max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1


_CUE = re.compile(r"([^\W\d]\w*)[\"'’]?\s{0,2}(?:no\.?|nr\.?|number)?[\s:=!\"'’(\[#.]{0,6}\Z", re.I)


def _cue(text: str, at: int) -> str:
    """'cell' within a row of a table, else the last word before, in lower case."""
    before = text[max(_line(text, at), at - 40) : at]
    bare = before.rstrip("\"'")
    if bare.endswith(("\t", ",", "| ", "|", "  ")):
        return "cell"
    m = _CUE.search(before)
    return m.group(1).lower() if m else ""


FIELDS = ["kind", "form", "start_pos", "end_pos", "w1", "w2", "e1", "e2", "line", "cue"]


def candidates(text: str) -> list[tuple]:
    """Rows of FIELDS. Names have their words and whether a mail address close by is made of these; others a form and a cue."""
    out: list[tuple] = []
    mails = _emails(text)
    ends = [b for _, b in mails]
    parts = [[p for p in _NO_LETTER.split(_folded(_ENDS_LOCAL.split(text[a:b].lower())[0])) if p] for a, b in mails]
    for a, b in mails:
        out.append(("email", "mail", a, b, None, None, False, False, _line(text, a), None))

    def free(a: int, b: int) -> bool:
        i = bisect_left(ends, a + 1)
        return i == len(mails) or mails[i][0] >= b

    for m in _NUMBERS.finditer(text):
        form = next(k for k, v in m.groupdict().items() if v)
        a, b = m.span()
        if form in _PHONES and not 9 <= sum(map(str.isdigit, m.group())) <= 15 or not free(a, b):
            continue
        out.append(("phone" if form in _PHONES else "id_number", form, a, b, None, None, False, False, _line(text, a), _cue(text, a)))
    for m in _STREETS.finditer(text):
        a, b = m.span()
        if unit := _UNIT_BEFORE.search(text, max(0, a - 24), a):
            a = unit.start()
        if free(a, b):
            out.append(("address", next(k for k, v in m.groupdict().items() if v), a, b, None, None, False, False, _line(text, a), _cue(text, a)))

    def name(form: str, a: int, b: int, w1: str | None, w2: str | None) -> None:
        if not free(a, b):
            return
        w1, w2 = (w and w.split("-")[0].lower() for w in (w1, w2))
        near: list[str] = []
        for i in range(bisect_left(ends, a - NEAR), len(mails)):
            if mails[i][0] > b + NEAR:
                break
            near += parts[i]
        e1, e2 = bool(w1 and near and _matches(_folded(w1), near)), bool(w2 and near and _matches(_folded(w2), near))
        out.append(("name", form, a, b, w1, w2, e1, e2, _line(text, a), None))

    for m in _NAMES.finditer(text):
        at = m.start()
        if m["a"]:
            name("given_family", at, m.end("a"), text[at : m.end("a1")], m["a2"])
        if m["b"]:
            name("initial_family", at, m.end("b"), None, m["b2"])
        if m["c"]:
            particle = _BEFORE_NAME.search(text, max(0, at - 16), at)
            name("family_given" if m["c2"] else "family_initial", particle.start() if particle else at, m.end("c"), text[at : m.end("c1")], m["c2"])
    return out


_SCHEMA = "key {}, h bigint, kind string, form string, start_pos bigint, end_pos bigint, w1 string, w2 string, e1 boolean, e2 boolean, line bigint, cue string, n_words bigint, n_lines bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["key", "h", *FIELDS, "n_words", "n_lines"]
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            batch = whole.slice(lo, 500)
            at, rows = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = candidates(text)
                at += [i] * (len(found) + 1)
                rows += [(*f, None, None) for f in found]
                rows.append(("total", None, None, None, None, None, None, None, None, None, text.count(" ") + 1, text.count("\n") + 1))
            take = pa.array(at, pa.int64())
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *cols], names=names)


def scan(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.where(F.length(F.col(text)) > 0).select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    ship(df.sparkSession)
    return rows.mapInArrow(_scan, _SCHEMA.format(rows.schema["key"].dataType.simpleString()))


def _bits(hit: Column, n: Column, prior: float, chance: float) -> Column:
    return F.log2(F.greatest(hit, F.lit(1e-9)) / n / F.lit(min(max(prior, 1e-9), chance)))


def lexicon(cands: DataFrame, n_words: int) -> DataFrame:
    """word, role ('given', 'family' or null): words that reveal persons. First by mail addresses, then by the words they stand with."""
    names = cands.where("kind = 'name'")
    full = F.col("e1") & F.col("e2")
    first = F.struct(F.col("w1").alias("word"), F.col("e1").alias("e"), full.alias("full"))
    last = F.struct(F.col("w2").alias("word"), F.col("e2").alias("e"), full.alias("full"))
    # equal words combine on the map side; the table of words follows the vocabulary
    seen = names.select(F.explode(F.array(first, last)).alias("t")).select("t.*").where("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e").cast("bigint")).alias("hit"), F.max("full").alias("full"))
    total = seen.agg(F.sum("hit").alias("hit")).first().hit or 0
    # once is enough where the address beside it is made of both words of the name
    known = seen.where(((F.col("hit") >= 2) | F.col("full")) & (_bits(F.col("hit"), F.col("n"), total / max(1, n_words), WORD_CHANCE) >= WORD_BITS)).select("word")
    pairs = names.where("form = 'given_family'").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.join(known.select(F.col("word").alias("w1"), F.lit(1).alias("k1")), "w1", "left").join(known.select(F.col("word").alias("w2"), F.lit(1).alias("k2")), "w2", "left")
    both = pairs.where("k1 = 1 AND k2 = 1")
    roles = both.select(F.explode(F.array(F.struct(F.col("w1").alias("word"), F.col("n").alias("g"), F.lit(0).alias("f")), F.struct(F.col("w2").alias("word"), F.lit(0).alias("g"), F.col("n").alias("f")))).alias("t")).select("t.*")
    roles = roles.groupBy("word").agg(F.when(F.sum("g") >= F.sum("f"), "given").otherwise("family").alias("role"))
    known = known.join(roles, "word", "left")
    # a word that follows given names, or comes before family names, in half of its pairs or more
    g = known.where("role = 'given'").select(F.col("word").alias("w1"), F.lit(1).alias("g1"))
    f = known.where("role = 'family'").select(F.col("word").alias("w2"), F.lit(1).alias("f2"))
    met = pairs.join(g, "w1", "left").join(f, "w2", "left")
    family = met.where("k2 IS NULL").groupBy(F.col("w2").alias("word")).agg(F.sum(F.coalesce("g1", F.lit(0)) * F.col("n")).alias("hit"), F.sum("n").alias("n")).where("hit >= 2 AND hit >= 0.5 * n").select("word", F.lit("family").alias("role"))
    given = met.where("k1 IS NULL").groupBy(F.col("w1").alias("word")).agg(F.sum(F.coalesce("f2", F.lit(0)) * F.col("n")).alias("hit"), F.sum("n").alias("n")).where("hit >= 2 AND hit >= 0.5 * n").select("word", F.lit("given").alias("role"))
    return known.union(family).union(given).groupBy("word").agg(F.min("role").alias("role"))


def _accepted_names(cands: DataFrame, words: DataFrame) -> DataFrame:
    one = words.select(F.col("word").alias("w1"), F.lit(True).alias("k1"), F.col("role").alias("r1"))
    two = words.select(F.col("word").alias("w2"), F.lit(True).alias("k2"), F.col("role").alias("r2"))
    names = cands.where("kind = 'name'").join(one, "w1", "left").join(two, "w2", "left")
    given = lambda k, r: f"({k} AND coalesce({r}, 'given') = 'given')"
    family = lambda k, r: f"({k} AND coalesce({r}, 'family') = 'family')"
    rule = (
        f"(form = 'given_family' AND {given('k1', 'r1')} AND {family('k2', 'r2')}) OR (form = 'initial_family' AND {family('k2', 'r2')})"
        f" OR (form = 'family_given' AND {family('k1', 'r1')} AND {given('k2', 'r2')}) OR (form = 'family_initial' AND {family('k1', 'r1')})"
    )
    return names.where(F.expr(rule)).select(*cands.columns)


def _accepted_forms(cands: DataFrame, names: DataFrame, n_lines: int) -> DataFrame:
    """Numbers and streets, each by its own context: its form stands unless the cue before it names something else. Then its line
    must hold a person, or its form or its form and cue disclose persons. Each text counts once, whatever its copies."""
    lines = cands.where("kind = 'email'").select("h", "line").union(names.select("h", "line")).distinct().withColumn("held", F.lit(1))
    prior = lines.count() / max(1, n_lines)
    others = cands.where("kind IN ('phone', 'id_number', 'address')")
    there = others.join(lines, ["h", "line"], "left").select(*cands.columns, F.coalesce("held", F.lit(0)).alias("held"))
    once = there.dropDuplicates(["h", "kind", "form", "start_pos", "end_pos"])  # copies of a text are no further evidence
    counts = once.where("form != 'nine'").groupBy("kind", "form", "cue").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("hit"))
    discloses = lambda: _bits(F.col("hit"), F.col("n"), prior, LINE_CHANCE) >= LINE_BITS
    forms = counts.groupBy("kind", "form").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).where(discloses()).select("kind", "form", F.lit(True).alias("by_form"))
    groups = counts.where(discloses()).select("kind", "form", "cue", F.lit(True).alias("by_cue"))
    sure = there.where("form != 'nine'").join(forms, ["kind", "form"], "left").join(groups, ["kind", "form", "cue"], "left")
    sure = sure.where(~F.col("cue").isin(*_OTHER_CUES) | (F.col("held") == 1) | F.col("by_form") | F.col("by_cue"))
    # nine digits alone say nothing; a cue does, that comes before sure forms or stands in persons' lines
    before = sure.where("kind = 'id_number'").dropDuplicates(["h", "start_pos", "end_pos"]).groupBy("cue").agg(F.count(F.lit(1)).alias("n_sure"))
    bare = there.where("form = 'nine'")
    cues = once.where("form = 'nine'").groupBy("cue").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("hit")).join(before, "cue", "left")
    cues = cues.where(~F.col("cue").isin("", *_OTHER_CUES) & (F.col("cue").isin(*_ID_CUES) | (_bits(F.col("hit"), F.col("n"), prior, LINE_CHANCE) >= LINE_BITS) | (F.coalesce("n_sure", F.lit(0)) >= 0.5 * F.col("n")))).select("cue")
    return sure.select(*cands.columns).union(bare.join(cues, "cue", "left_semi").select(*cands.columns))


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: spans that don't overlap; the stronger kind first, then full names, then the longer and the earlier."""
    seg = pa.list_(pa.struct([("pii_kind", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())]))
    rank = {k: i for i, k in enumerate(KINDS)} | {"given_family": 0, "family_given": 1, "initial_family": 2, "family_initial": 3}
    for batch in batches:
        out = []
        for spans in batch.column(2).to_pylist():
            spans = sorted({(s["kind"], s["form"], s["start_pos"], s["end_pos"]) for s in spans}, key=lambda s: (rank[s[0]], rank.get(s[1], 0), s[2] - s[3], s[2]))
            taken: list[tuple[int, int, str]] = []
            for kind, _, a, b in spans:
                i = bisect_left(taken, (a, -1, ""))
                if (i == len(taken) or taken[i][0] >= b) and (i == 0 or taken[i - 1][1] <= a):
                    taken.insert(i, (a, b, kind))
            out.append([{"pii_kind": k, "start_pos": a, "end_pos": b} for a, b, k in taken])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, seg)], names=["key", "h", "spans"])


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, h, spans (array of pii_kind, start_pos, end_pos in code points): one row per key and text that holds any.

    h is a hash of the text: rows that repeat key and text are one row, and rows that share a key alone stay apart. Keys may be
    null; null and empty texts hold nothing. Other columns are not read.
    """
    spool = Spool(df.sparkSession)
    cands = spool.write(scan(df, key, text))
    totals = cands.where("kind = 'total'").groupBy("h").agg(F.sum("n_words").alias("w"), F.max("n_lines").alias("l")).agg(F.sum("w").alias("w"), F.sum("l").alias("l")).first()
    cands = cands.drop("n_words", "n_lines")
    words = spool.write(lexicon(cands, totals.w or 0))
    names = spool.write(_accepted_names(cands, words))
    hits = cands.where("kind = 'email'").union(names).union(_accepted_forms(cands, names, totals.l or 0))
    grouped = hits.groupBy("key", "h").agg(F.collect_list(F.struct("kind", "form", "start_pos", "end_pos")).alias("s"))
    kind = cands.schema["key"].dataType.simpleString()
    return grouped.mapInArrow(_resolve, f"key {kind}, h bigint, spans array<struct<pii_kind:string,start_pos:bigint,end_pos:bigint>>")


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            batch = whole.slice(lo, 500)
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text is not None and spans:
                    parts, at = [], 0
                    for s in spans:
                        parts += [text[at : s["start_pos"]], f"[{s['pii_kind'].upper()}]"]
                        at = s["end_pos"]
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array([len(s or ()) for s in batch.column(2).to_pylist()], pa.int64())], names=["key", "text", "n_replaced"])


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, n_replaced) of every row: typed placeholders in place of the findings, all else as it was; null stays null."""
    found = find(df, key, text)
    rows = df.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    joined = rows.join(found.withColumnRenamed("key", "_k").withColumnRenamed("h", "_h"), F.col("key").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h")), "left").select("key", "text", "spans")
    kind = rows.schema["key"].dataType.simpleString()
    return joined.mapInArrow(_replace, f"key {kind}, text string, n_replaced bigint").withColumnRenamed("key", key)
