"""Language of documents and of their segments, with confidence, by string kernels.

Model: blended-spectrum presence kernel (n-grams of 1 to ``N`` characters that two texts share, however often either holds them,
divided by the root of both texts' numbers), Nystroem features on landmark texts, one-versus-rest kernel ridge regression. As the
kernel is linear in the n-gram indicators, landmarks and regression weights fold into one matrix (n-gram x language): the scores
of a batch of words or of segments are the product of its sparse indicator matrix (segment x n-gram) and that matrix.

Segments: a text is cleaned (width forms, invisible characters, letters of other scripts drawn alike), mark-up, quoted titles,
IRIs and tokens with digits are left out, and clauses are cut at strong punctuation. Within a clause the best path over the
words' scores, with a price for each change, finds changes of language that nothing marks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.runtime import ship

N = 5
#: Bounds of the fit: labelled texts read per language, and landmarks in all. Both are stated limits of the model, not of the data.
SAMPLES_PER_LANGUAGE = 500
AGREED_PER_LANGUAGE = 120
LANDMARKS = 900
RIDGE = 0.3
SWITCH = 0.8
TEMPERATURE = 0.06
LEAST_SCORE = 0.04
_CACHE = 200_000
_BATCH = 256
_TOGETHER = 200  # words of a clause up to which paths are searched for many clauses at a time

# ISO 639-1 and ISO 639-3 codes.
_CODES = """
ab abk aa aar af afr ak aka sq sqi am amh ar ara an arg hy hye as asm av ava ae ave ay aym az aze bm bam ba bak eu eus be bel bn ben bi bis bs bos br bre bg bul my mya
ca cat ch cha ce che ny nya zh zho cu chu cv chv kw cor co cos cr cre hr hrv cs ces da dan dv div nl nld dz dzo en eng eo epo et est ee ewe fo fao fj fij fi fin fr fra fy fry ff ful
gd gla gl glg lg lug ka kat de deu el ell kl kal gn grn gu guj ht hat ha hau he heb hz her hi hin ho hmo hu hun is isl io ido ig ibo id ind ia ina ie ile iu iku ik ipk ga gle it ita
ja jpn jv jav kn kan kr kau ks kas kk kaz km khm ki kik rw kin ky kir kv kom kg kon ko kor kj kua ku kur lo lao la lat lv lav li lim ln lin lt lit lu lub lb ltz mk mkd mg mlg ms msa
ml mal mt mlt gv glv mi mri mr mar mh mah mn mon na nau nv nav nd nde nr nbl ng ndo ne nep no nor nb nob nn nno oc oci oj oji or ori om orm os oss pi pli ps pus fa fas pl pol pt por
pa pan qu que ro ron rm roh rn run ru rus se sme sm smo sg sag sa san sc srd sr srp sn sna sd snd si sin sk slk sl slv so som st sot es spa su sun sw swa ss ssw sv swe tl tgl ty tah
tg tgk ta tam tt tat te tel th tha bo bod ti tir to ton ts tso tn tsn tr tur tk tuk tw twi ug uig uk ukr ur urd uz uzb ve ven vi vie vo vol wa wln cy cym wo wol xh xho ii iii yi yid
yo yor za zha zu zul
""".split()
ISO_639_3 = dict(zip(_CODES[::2], _CODES[1::2]))

# Letters of other scripts drawn like Latin ones, and the Latin letters.
_CYRILLIC, _CYRILLIC_LATIN = "аеорсхуіѕјһԁԛԝАВЕКМНОРСТХІЈЅУёїЁЇ", "aeopcxyisjhdqwABEKMHOPCTXIJSYëïËÏ"
_GREEK, _GREEK_LATIN = "ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧόΆΈΉΊΌΎ", "ovcjABEZHIKMNOPTYXóÁÉHÍÓÝ"
_TO_LATIN = dict(zip(_CYRILLIC + _GREEK, _CYRILLIC_LATIN + _GREEK_LATIN, strict=True))
_TO_CYRILLIC = {b: a for a, b in zip(_CYRILLIC, _CYRILLIC_LATIN, strict=True)}
_TO_GREEK = {b: a for a, b in zip(_GREEK, _GREEK_LATIN, strict=True)}
_PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "AE", "ß": "ss", "đ": "d", "œ": "oe"})

_IRI = re.compile(r"\b(?:urn:|[a-z][a-z0-9+.-]*://|www\.)[^\s<>“”]*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ASCII_WORD = re.compile("[a-z]+(?:'[a-z]+)*")
#: Mark-up, quoted titles, tokens with digits and the unit after them, strong punctuation. It begins with the set of first characters.
#: A search for the closing mark ends at the next opening one or at the end of the line, so it takes linear time.
_BREAK = re.compile(
    r'[<“"«„‹0-9.;|/=()\[\]{}:!?\n–—#×*]'
    r'(?:(?<=<)[^<>\n]*+>|(?<=“)[^“”\n]*+”|(?<=")[^"\n]*+"|(?<=«)[^«»\n]*+»|(?<=„)[^„“”\n]*+[“”]|(?<=‹)[^‹›\n]*+›'
    r"|(?<=[0-9])[^\s,;()\[\]|=]*(?:\s?[^\W\d_]{1,2}\b)?)?"
)
_SHORT_END = re.compile(r"(?:^|(?<=[\s,]))[^\W\d_]{1,4}[-.]?\s{0,3}\Z")  # a short word before a number, as in "fol. 12"
_INVISIBLE = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Cf") + "]")
_RUN = re.compile(r"(?:[\x00-\x7f](?![^\x00-\x7f]))+")  # characters that stay as they are, and that no accent follows
_LATIN = re.compile("[A-Za-zÀ-\u024f]")
_OTHER = re.compile("[\u0370-\u052f\u1f00-\u1fff]")


def _fold(text: str) -> tuple[str, list[int] | None]:
    """Width forms and joined letters made plain, invisible characters dropped, accents composed; and each character's position."""
    if text.isascii() or unicodedata.is_normalized("NFKC", text) and not _INVISIBLE.search(text):
        return text, None
    out, at = [], []
    i, n = 0, len(text)
    while i < n:
        if run := _RUN.match(text, i):
            out.append(run.group())
            at += range(i, run.end())
            i = run.end()
            continue
        j = i + 1
        while j < n and unicodedata.combining(text[j]):
            j += 1
        piece = text[i:j]
        if unicodedata.category(piece[0]) != "Cf":
            plain = unicodedata.normalize("NFKC", piece if j == i + 1 else "".join(c for c in piece if unicodedata.category(c) != "Cf"))
            out.append(plain)
            at += [i] * len(plain)
        i = j
    at.append(n)
    return "".join(out), at


def _script(c: str) -> str:
    o = ord(c)
    return "C" if 0x400 <= o < 0x530 else "G" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "L"


def _mend(words: list[str]) -> list[str]:
    """Words whose letters are of several scripts, or only of letters drawn alike, go to the script that they stand for."""
    whole = " ".join(words)
    if not _OTHER.search(whole) or not _LATIN.search(whole):
        return words
    scripts = [{_script(c) for c in w if c.isalpha()} for w in words]
    sure = {"L": 0, "C": 0, "G": 0}
    for w in words:
        for c in w:
            s = _script(c)
            if s == "L":
                sure["L"] += c not in _TO_CYRILLIC and c not in _TO_GREEK
            else:
                sure[s] += c not in _TO_LATIN
    out = []
    for w, s in zip(words, scripts):
        if len(s) > 1:
            other = "C" if "C" in s else "G"
            fixed = [c for c in w if _script(c) != "L" and c not in _TO_LATIN]
            if fixed:
                back = _TO_CYRILLIC if other == "C" else _TO_GREEK
                w = "".join(back.get(c, c) for c in w)
            else:
                w = "".join(_TO_LATIN.get(c, c) for c in w)
        elif s and s != {"L"} and all(c in _TO_LATIN or not c.isalpha() for c in w) and sure["L"] > sure[next(iter(s))]:
            w = "".join(_TO_LATIN.get(c, c) for c in w)
        out.append(w)
    return out


def _strip(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.translate(_PLAIN)) if not unicodedata.combining(c))


def clauses(text: str) -> tuple[list[tuple[str, int]], list[int] | None]:
    """Clauses with their positions in the folded text, and the positions of its characters; what is no prose is left out."""
    plain, at = _fold(text)
    if "urn:" in plain or "://" in plain or "www." in plain:
        plain = _IRI.sub(lambda m: ";" * len(m.group()), plain)
    found, start = [], 0
    for m in _BREAK.finditer(plain):
        end = m.start()
        if end - start > 2:  # two words take three characters
            clause = plain[start:end]
            if plain[end].isdigit():
                short = _SHORT_END.search(clause, max(0, len(clause) - 9))  # it takes eight characters at most
                clause = clause[: short.start()] if short else clause
            found.append((clause, start))
        start = m.end()
    if len(plain) - start > 2:
        found.append((plain[start:], start))
    return found, at


def words_of(clause: str) -> list[str]:
    """Words in lower case and in one script."""
    if clause.isascii():
        return _ASCII_WORD.findall(clause.lower())
    words = _mend(_WORD.findall(clause))
    return " ".join(words).lower().split(" ") if words else []


def _grams(word: str) -> set[str]:
    padded = f" {word} "
    n = len(padded)
    return {padded[i : i + k] for k in range(1, N + 1) for i in range(n - k + 1)} - {" "}


class Indicator:
    """A sparse matrix of zeros and ones by rows, from places that may repeat."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int]) -> None:
        self.shape = shape
        kind = np.int32 if shape[0] * shape[1] < 2**31 else np.int64  # the shorter numbers are sorted faster
        places = np.sort(rows.astype(kind) * kind(shape[1]) + cols.astype(kind))
        places = places[np.diff(places, prepend=kind(-1)) > 0]
        self.rows = places // kind(max(1, shape[1]))
        self.cols = places - self.rows * kind(shape[1])

    def row_sums(self) -> np.ndarray:
        return np.bincount(self.rows, minlength=self.shape[0])

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], weights.shape[1]), weights.dtype)
        if len(self.cols):
            starts = np.flatnonzero(np.diff(self.rows, prepend=-1))
            out[self.rows[starts]] = np.add.reduceat(weights.take(self.cols, 0), starts)
        return out


class Model:
    """Folded model: n-gram -> row of ``weights`` (n-grams x languages)."""

    def __init__(self, languages: list[str], index: dict[str, int], weights: np.ndarray) -> None:
        self.languages, self.index, self.weights = languages, index, weights
        self._clauses: dict[str, list] = {}
        self._forget_words()

    def __reduce__(self) -> tuple:
        return Model, (self.languages, self.index, self.weights)

    def _forget_words(self) -> None:
        """The vocabulary: each word's number, and by number where its columns lie in ``_columns``, how many they are, how many of
        its n-grams no landmark holds, and its own scores."""
        self._numbers: dict[str, int] = {}
        self._columns = np.zeros(0, np.int32)
        self._first, self._held, self._strange = (np.zeros(0, np.int64) for _ in range(3))
        self._own = np.zeros((0, len(self.languages)))

    def _numbered(self, words: list[str]) -> np.ndarray:
        """Number of each word in the vocabulary, which takes in the new ones."""
        new = [w for w in dict.fromkeys(words) if w not in self._numbers]
        if new and len(self._numbers) + len(new) > _CACHE:
            self._forget_words()
            new = list(dict.fromkeys(words))
        if new:
            grams = [_grams(w) for w in new]
            columns = [sorted(i for g in gs if (i := self.index.get(g)) is not None) for gs in grams]
            held, n = np.array([len(c) for c in columns], np.int64), len(self._numbers)
            self._first = np.concatenate([self._first, len(self._columns) + held.cumsum() - held])
            self._held = np.concatenate([self._held, held])
            self._strange = np.concatenate([self._strange, [len(gs) for gs in grams] - held])
            self._columns = np.concatenate([self._columns, np.array([i for c in columns for i in c], np.int32)])
            self._numbers.update(zip(new, range(n, n + len(new))))
            self._own = np.concatenate([self._own, self._scores(np.arange(n, n + len(new)), np.ones(len(new), np.int64))])
        return np.fromiter(map(self._numbers.__getitem__, words), np.int64, len(words))

    def scores(self, groups: list[list[str]]) -> np.ndarray:
        """Score of each group of words in each language."""
        return self._scores(self._numbered([w for ws in groups for w in ws]), np.array([len(ws) for ws in groups], np.int64))

    def _scores(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of groups of so many words each: the sparse indicator matrix of ``_BATCH`` groups times the weights.

        An n-gram counts once in a group. N-grams that no landmark holds add to a group's number alone, once a word.
        """
        out = np.zeros((len(sizes), len(self.languages)))
        ends = sizes.cumsum()
        for lo in range(0, len(sizes), _BATCH):
            n = sizes[lo : lo + _BATCH]
            part = words[ends[lo] - n[0] : ends[lo + len(n) - 1]]
            owner, held = np.repeat(np.arange(len(n)), n), self._held[part]
            at = np.repeat(self._first[part] - held.cumsum() + held, held) + np.arange(held.sum())
            x = Indicator(np.repeat(owner, held), self._columns[at], (len(n), len(self.index)))
            size = x.row_sums() + np.bincount(owner, self._strange[part], len(n))
            out[lo : lo + _BATCH] = (x @ self.weights) / np.sqrt(np.maximum(1, size))[:, None]
        return out

    def path(self, e: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words of one language: the best path over word scores less SWITCH for each change."""
        rows = e.tolist()  # a handful of languages: plain lists are faster than arrays here
        score, back = rows[0], []
        for row in rows[1:]:
            most = max(score)
            top, floor = score.index(most), most - SWITCH
            back.append([k if s >= floor else top for k, s in enumerate(score)])
            score = [max(s, floor) + x for s, x in zip(score, row)]
        way = [score.index(max(score))]
        for step in reversed(back):
            way.append(step[way[-1]])
        way.reverse()
        cuts = [0, *(i for i in range(1, len(way)) if way[i] != way[i - 1]), len(way)]
        return list(zip(cuts[:-1], cuts[1:]))

    def paths(self, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int]]]:
        """path() of the clauses whose words begin at ``starts``: short ones together, a word of each at a time, longest first."""
        out: list = [None] * len(sizes)
        for i in np.flatnonzero(sizes > _TOGETHER).tolist():
            out[i] = self.path(e[starts[i] : starts[i] + sizes[i]])
        order = np.flatnonzero(sizes <= _TOGETHER)
        if not len(order):
            return out
        order = order[np.argsort(-sizes[order], kind="stable")]
        at, n, same = starts[order], sizes[order], np.arange(e.shape[1])
        live = np.searchsorted(-n, -np.arange(n[0])).tolist()  # clauses that have a word at this place
        score, back = e[at], []
        for t in range(1, n[0]):
            now = score[: live[t]]
            floor = now.max(1, keepdims=True) - SWITCH
            back.append(np.where(now >= floor, same, now.argmax(1)[:, None]))
            score[: live[t]] = np.maximum(now, floor) + e[at[: live[t]] + t]
        way = np.zeros((len(n), n[0]), np.int64)
        last = score.argmax(1)
        for t in range(n[0] - 1, 0, -1):
            way[: live[t], t] = last[: live[t]]
            last[: live[t]] = back[t - 1][np.arange(live[t]), last[: live[t]]]
        way[:, 0] = last
        cut = way[:, 1:] != way[:, :-1]
        cut &= np.arange(1, n[0]) < n[:, None]
        for i, m, c in zip(order.tolist(), n.tolist(), cut):
            cuts = [0, *(np.flatnonzero(c) + 1).tolist(), m]
            out[i] = list(zip(cuts[:-1], cuts[1:]))
        return out

    def label(self, parts: list[str]) -> None:
        """Fills the cache with each clause's segments: start, end, language, confidence, words.

        The words' own scores, which show changes of language, and the segments' scores come from products over the whole batch.
        """
        new = [p for p in dict.fromkeys(parts) if p not in self._clauses]
        if len(self._clauses) + len(new) > _CACHE:
            self._clauses.clear()
            new = list(dict.fromkeys(parts))
        kept, starts, flat = [], [], []
        for p in new:
            self._clauses[p] = []
            got = words_of(p)
            if len(got) > 1:
                kept.append((p, got))
                starts.append(len(flat))
                flat += got
        if not kept or not self.languages:
            return
        words = self._numbered(flat)
        alone, first = self._own[words], np.array(starts)
        change = np.add.reduceat(alone.max(1), first) - SWITCH > np.add.reduceat(alone, first).max(1)
        sizes = np.diff(first, append=len(flat))
        moved = iter(self.paths(alone, first[change], sizes[change]))
        spans = []
        for (p, got), moves in zip(kept, change.tolist()):
            ways = next(moved) if moves else []
            if all(b - a < 2 for a, b in ways):  # no change, or changes at every word: one phrase
                ways = [(0, len(got))]
            places = [m.span() for m in _WORD.finditer(p)] if len(ways) > 1 else [_WORD.search(p).span(), (0, len(p.rstrip(" ,\t'’")))]
            for a, b in ways:
                spans.append((p, places[a][0], places[b - 1 if len(ways) > 1 else 1][1], b - a))
        scores = self._scores(words, np.array([n for *_, n in spans]))  # spans follow each other and leave out no word
        best = scores.argmax(1)
        top = scores.max(1)
        sure = 1 / np.exp((scores - top[:, None]) / TEMPERATURE).sum(1)
        for (p, start, end, n), k, t, c in zip(spans, best.tolist(), top.tolist(), sure.tolist()):
            if n > 1 and t >= LEAST_SCORE:
                self._clauses[p].append((start, end, self.languages[k], c, n))

    def segments(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """Per text its segments: start and end position, language, confidence. Neighbours of one language are one segment."""
        cut = [clauses(t) if t else ([], None) for t in texts]
        self.label([c for cs, _ in cut for c, _ in cs])
        out = []
        for cs, at in cut:
            found: list[tuple[int, int, str, float, int]] = []
            for c, off in cs:
                for a, b, lang, sure, n in self._clauses[c]:
                    start, end = (off + a, off + b) if at is None else (at[off + a], at[off + b])
                    if found and found[-1][2] == lang:
                        p = found[-1]
                        found[-1] = (p[0], end, lang, (p[3] * p[4] + sure * n) / (p[4] + n), p[4] + n)
                    else:
                        found.append((start, end, lang, sure, n))
            out.append([f[:4] for f in found])
        return out


def fit(samples: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From (language, text) pairs; each text also trains without its accents. Deterministic."""
    texts = []
    for lang, text in samples:
        words = [w for c, _ in clauses(text)[0] for w in words_of(c)]
        texts += [(lang, words), (lang, [_strip(w) for w in words])]
    texts = [(lang, set().union(*map(_grams, words))) for lang, words in texts if words]
    languages = sorted({lang for lang, _ in texts})
    step = max(1, -(-len(texts) // landmarks))
    marks = [g for _, g in texts[::step]]
    index = {g: i for i, g in enumerate(sorted(set().union(*marks) if marks else set()))}

    def rows(grams: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(grams), len(index)), np.float32)
        for i, c in enumerate(grams):
            x[i, [index[g] for g in c if g in index]] = 1 / np.sqrt(max(1, len(c)))
        return x

    if not texts:
        return Model([], {}, np.zeros((0, 0), np.float32))
    xl = rows(marks)
    k_mm = (xl @ xl.T).astype(np.float64)
    k_nm = np.vstack([rows([g for _, g in texts[lo : lo + 128]]) @ xl.T for lo in range(0, len(texts), 128)]).astype(np.float64)
    value, vector = np.linalg.eigh(k_mm)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = k_nm @ root
    y = np.array([[float(lang == x) for x in languages] for lang, _ in texts])
    w = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
    return Model(languages, index, xl.T @ (root @ w).astype(np.float32))


def _first(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    from pyspark.sql.window import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n)


def _draw(texts: DataFrame, n: int) -> list:
    """The n distinct texts of each language whose hash is least (all if there are fewer), in that order.

    The first n of a language lie below some bound of the hash, so only rows below a bound are made distinct; where repeats leave
    a language short of n, its bound rises until it has them or takes in every row.
    """
    counts = {r.lang: r.n for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language of the model
    share = {lang: min(1.0, 8 * n / k) for lang, k in counts.items()}
    done: dict[str, list] = {}
    while len(done) < len(counts):
        left = sorted(set(counts) - set(done))
        bound = F.create_map(*[F.lit(x) for lang in left for x in (lang, int(share[lang] * 2**64) - 2**63 if share[lang] < 1 else 2**63 - 1)])
        below = texts.where(F.col("lang").isin(left)).where(F.xxhash64("text") <= F.element_at(bound, F.col("lang"))).distinct()
        rows = _first(below, "lang", [F.xxhash64("text"), F.col("text")], n).orderBy("lang", "_r").collect()
        for lang in left:
            own = [r for r in rows if r.lang == lang]
            if len(own) == n or share[lang] >= 1:
                done[lang] = own
            share[lang] = min(1.0, 64 * share[lang])
    return [r for lang in sorted(done) for r in done[lang]]


def fit_table(samples: DataFrame, labelled: DataFrame | None = None) -> Model:
    """Two fits. The first on samples (lang, sample_text), at most SAMPLES_PER_LANGUAGE a language, the first by sample_id.

    The second adds rows of ``labelled`` (label, text), at most AGREED_PER_LANGUAGE of those that a hash puts first among the
    texts of 40 to 400 characters: rows whose label names a language, that the first fit finds in that language throughout.
    """
    rows = _first(samples.where("lang IS NOT NULL AND sample_text IS NOT NULL"), "lang", [F.col("sample_id"), F.col("sample_text")], SAMPLES_PER_LANGUAGE)
    known = [(r.lang, r.sample_text) for r in rows.select("lang", "sample_text", "_r").orderBy("lang", "_r").collect()]
    if strange := sorted({lang for lang, _ in known} - set(ISO_639_3)):
        raise ValueError(f"samples of languages that labels can't name: {', '.join(strange)}; the codes must be ISO 639-1")
    model = fit(known)
    if labelled is None or not known:
        return model
    drawn = _draw(labelled.select(named(F.col("label")).alias("lang"), "text").where(F.length("text").between(40, 400) & F.col("lang").isin(model.languages)), 2 * AGREED_PER_LANGUAGE)
    found = model.segments([r.text for r in drawn])
    agreed = [(r.lang, r.text) for r, f in zip(drawn, found) if len(f) == 1 and f[0][2] == r.lang and f[0][3] > 0.8]
    kept, count = [], dict.fromkeys(model.languages, 0)
    for lang, text in agreed:
        if count[lang] < AGREED_PER_LANGUAGE:
            count[lang] += 1
            kept.append((lang, text))
    return fit(known + kept)


def segments(df: DataFrame, key: str, text: str, label: str, model: Model) -> DataFrame:
    """key, label, segs (array of start_pos, end_pos, lang, confidence): one row per row of df, keys repeated or null as they come.

    A text without a phrase of two words in prose has no segments; so have null and empty texts.
    """
    shared = ship(df.sparkSession).sparkContext.broadcast(model)  # n-grams of at most LANDMARKS texts
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(text).alias("text"))
    seg = pa.list_(pa.struct([("start_pos", pa.int64()), ("end_pos", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                found = m.segments(batch.column(2).to_pylist())
                ends = np.cumsum([0, *map(len, found)])
                parts = list(zip(*(x for f in found for x in f))) or [()] * 4
                each = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(parts, seg.value_type)], fields=list(seg.value_type))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each, type=seg)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["key", "label", "segs"])

    kind = "array<struct<start_pos:bigint,end_pos:bigint,lang:string,confidence:double>>"
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("label", T.StringType()), T.StructField("segs", T._parse_datatype_string(kind))])
    return rows.mapInArrow(run, schema)


def named(label: Column) -> Column:
    """The language that a label names, in two letters; null if none."""
    tag = F.regexp_extract(F.lower(label), r"^([a-z]+)(?:[-_].*)?$", 1)
    codes = F.create_map(*[F.lit(x) for two, three in ISO_639_3.items() for pair in ((two, two), (three, two)) for x in pair])
    return F.element_at(codes, tag)


def unnamed_languages(segs: DataFrame) -> DataFrame:
    """(key, lang): languages of a record's text that its label doesn't name."""
    per = segs.select("key", "label", F.explode(F.array_distinct("segs.lang")).alias("lang"))
    return per.where(~F.col("lang").eqNullSafe(named(F.col("label")))).select("key", "lang").distinct()


def main_language(segs: DataFrame) -> DataFrame:
    """key, lang, confidence of each record, without a shuffle: the language of most characters, the first in the alphabet at a tie."""
    chars = "aggregate(filter(segs, x -> x.lang = l), 0L, (n, x) -> n + x.end_pos - x.start_pos)"
    sure = "aggregate(filter(segs, x -> x.lang = l), 0D, (n, x) -> n + x.confidence) / size(filter(segs, x -> x.lang = l))"
    per = F.expr(f"transform(array_sort(array_distinct(segs.lang)), (l, i) -> struct({chars} AS chars, -i AS i, l AS lang, {sure} AS confidence))")
    return segs.select("key", F.array_max(per).alias("m")).select("key", "m.lang", "m.confidence")
