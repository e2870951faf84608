"""Full-text search over literals: tokens, prefixes, stems, sounds, numbers and ranges with AND, OR, NOT.

Syntax: ``word``, ``word*`` (prefix), ``word/i`` (any case), ``word/s`` (stem), ``word/S`` (sounds like), numbers, ``a..b``, ``>=n``,
``<=n``; words side by side are AND, ``OR``, ``-word`` is NOT, parentheses group; ``^text`` is a prefix of the whole literal.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.sources.graphs import TOKEN_BREAK

_TOKEN = re.compile(r"\s*(?:(?P<op>[()])|(?P<range>-?\d+(?:\.\d+)?\.\.-?\d+(?:\.\d+)?)|(?P<cmp>>=|<=|=<)\s*(?P<n>-?\d+(?:\.\d+)?)|(?P<not>-)(?=\S)|(?P<word>[^\s()]+))")


def parse(query: str):
    """A tree of ('and', [..]), ('or', [..]), ('not', x), ('prefix', text), ('word', w, mode), ('between', a, b)."""
    query = query.strip()
    if query.startswith("^"):
        return ("prefix", query[1:])
    toks = [m for m in _TOKEN.finditer(query) if m.group().strip()]
    at = 0

    def peek() -> str:
        return toks[at].group().strip() if at < len(toks) else ""

    def either():
        nonlocal at
        parts = [every()]
        while peek() == "OR":
            at += 1
            parts.append(every())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def every():
        nonlocal at
        parts = []
        while at < len(toks) and peek() not in (")", "OR"):
            if peek() == "AND":
                at += 1
                continue
            parts.append(one())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def one():
        nonlocal at
        m = toks[at]
        at += 1
        if m["op"] == "(":
            x = either()
            if peek() != ")":
                raise ValueError("a parenthesis is not closed")
            at += 1
            return x
        if m["op"]:
            raise ValueError("unexpected )")
        if m["not"]:
            return ("not", one())
        if m["range"]:
            a, b = m["range"].split("..") if m["range"].count("..") == 1 else m["range"].rsplit("..", 1)
            return ("between", float(a), float(b))
        if m["cmp"]:
            return ("between", float(m["n"]), None) if m["cmp"] == ">=" else ("between", None, float(m["n"]))
        w = m["word"]
        if re.fullmatch(r"\d+(\.\d+)?", w):
            return ("between", float(w), float(w))
        if w.endswith("*"):
            return ("word", w[:-1], "*")
        base, slash, mode = w.rpartition("/")
        if slash and mode in ("i", "s", "S") and base:
            return ("word", base, mode)
        return ("word", w, "")

    tree = either()
    if at < len(toks):
        raise ValueError("unexpected )")
    return tree


def words(text: Column) -> Column:
    return F.filter(F.split(text, TOKEN_BREAK), lambda w: w != "")


def needed(tree) -> set[str]:
    """Words in lower case that every match holds; an index of words finds all matches by any one of them."""
    match tree:
        case ("and", parts):
            return set().union(*map(needed, parts)) if parts else set()
        case ("or", parts):
            return set.intersection(*map(needed, parts))
        case ("word", w, "" | "i") if w.isalnum():
            return {w.lower()}
    return set()


# Endings of inflected words by language.
ENDINGS = {
    "da": "erne|ene|ede|er|en|et|e|s", "de": "ern|em|en|er|es|e|n|s", "es": "amientos?|mente|aciones|ación|os|as|es|o|a|e|s", "fr": "issements?|ements?|euses?|eaux|aux|ées?|és|es|er|e|s",
    "it": "amenti|amento|mente|azioni|azione|i|e|o|a", "nl": "heden|en|je|s|e", "no": "erne|ene|ede|er|en|et|e|s", "pt": "amentos?|mente|ações|ação|os|as|es|o|a|e|s", "sv": "arna|erna|orna|ar|er|or|en|et|n|t|a|e|s",
    "pl": "ami|ach|ów|om|ie|ę|ą|y|i|e|a|o|u", "cs": "ami|ách|ům|ou|ém|é|ý|í|y|i|e|a|o|u", "ru": "ами|ями|ах|ях|ов|ев|ой|ый|ий|ая|ое|ые|ом|ем|ы|и|е|а|я|о|у|ю|ь",
}
_STEM_FROM = 5  # shorter words stay whole


def stems_alike(word: Column, query: str, lang: Column | None) -> Column:
    """Whether a word of a text and one of the query have one stem, by the endings of the text's language; English where it names
    none of ENDINGS."""
    out = stem(word) == stem(F.lit(query))
    if lang is None:
        return out
    for code, endings in ENDINGS.items():
        short = lambda w: F.when(F.length(w) >= _STEM_FROM, F.regexp_replace(w, f"(?:{endings})$", "")).otherwise(w)  # noqa: B023, E731
        own = (F.lower(lang) == code) | F.lower(lang).startswith(code + "-")
        out = F.when(own, short(word) == short(F.lit(query))).otherwise(out)
    return out


def stem(word: Column) -> Column:
    """A light suffix stripper for lower-case English words; applied alike to query and text."""
    w = F.regexp_replace(word, r"(?:'s|’s)$", "")
    w = F.when((F.length(w) > 5), F.regexp_replace(w, r"(ational|ization|fulness|ousness|iveness)$", "")).otherwise(w)
    w = F.when(F.length(w) > 4, F.regexp_replace(w, r"(ies)$", "y")).otherwise(w)
    w = F.when(F.length(w) > 4, F.regexp_replace(w, r"(ings?|edly|ed|ers?|est|ly|es|en)$", "")).otherwise(w)
    return F.when(F.length(w) > 3, F.regexp_replace(w, r"(?<=[^s])s$", "")).otherwise(w)


def condition(tree, text: Column, lang: Column | None = None, only: str = "") -> Column:
    """The tree as a filter on a text column; ``only`` restricts the language."""
    tokens = words(text)

    def walk(x) -> Column:
        match x:
            case ("and", parts):
                out = F.lit(True)
                for p in parts:
                    out = out & walk(p)
                return out
            case ("or", parts):
                out = F.lit(False)
                for p in parts:
                    out = out | walk(p)
                return out
            case ("not", y):
                return ~walk(y)
            case ("prefix", p):
                return text.startswith(p)
            case ("between", a, b):
                n = lambda w: w.try_cast("double")
                return F.exists(tokens, lambda w: F.coalesce((n(w) >= a if a is not None else F.lit(True)) & (n(w) <= b if b is not None else F.lit(True)), F.lit(False)))
            case ("word", w, ""):
                return F.array_contains(tokens, w)
            case ("word", w, "*"):
                return F.exists(tokens, lambda x: x.startswith(w))
            case ("word", w, "i"):
                return F.exists(tokens, lambda x: F.lower(x) == w.lower())
            case ("word", w, "s"):
                return F.exists(tokens, lambda x: stems_alike(F.lower(x), w.lower(), lang))
            case ("word", w, "S"):
                return F.exists(tokens, lambda x: F.soundex(x) == F.soundex(F.lit(w)))
        raise TypeError(f"no text query: {x!r}")

    out = text.isNotNull() & walk(tree)
    if only and lang is not None:
        out = out & ((F.lower(lang) == only.lower()) | F.lower(lang).startswith(only.lower() + "-"))
    return out


def browse(query: str, text: Column) -> Column:
    """Search box: "quoted" is exact; else all tokens in any case, -token excluded."""
    query = query.strip()
    if len(query) > 1 and query[0] == query[-1] == '"':
        return text == query[1:-1]
    out = F.lit(True)
    low = F.transform(words(text), lambda w: F.lower(w))
    for w in re.findall(r"-?[^\W_]+", query):
        has = F.array_contains(low, w.lstrip("-").lower())
        out = out & (~has if w.startswith("-") else has)
    return text.isNotNull() & out


def complete(triples: DataFrame, prefix: str, label_properties: list[str], limit: int = 10) -> DataFrame:
    """text, n, label: literals that begin with the prefix in any case; labels first, then the most frequent."""
    hits = triples.where((F.col("o.k") == 3) & F.lower("o.lex").startswith(prefix.lower()))
    rows = hits.groupBy(F.col("o.lex").alias("text")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("p").isin(label_properties)).alias("label"))
    return rows.orderBy(F.desc("label"), F.desc("n"), "text").limit(limit)


def token_index(literals: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index (token, key), each pair once; write it partitioned by a prefix of the token to prune by it."""
    return literals.select(F.explode(F.array_distinct(F.transform(words(F.col(text)), lambda w: F.lower(w)))).alias("token"), F.col(key)).where("token IS NOT NULL")


def token_frequencies(literals: DataFrame, text: str) -> DataFrame:
    tokens = literals.select(F.explode(F.transform(words(F.col(text)), lambda w: F.lower(w))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
