"""Texts that look the same but differ in their characters: one canonical member for each class of equal look.

A text is mapped so that characters drawn alike coincide (width forms, kinds of space and of hyphen, joined letters, letters of
other scripts drawn alike; invisible characters vanish). Mapped values are grouped under the accent-sensitive, case-sensitive
UNICODE collation, under which composed and decomposed accents are equal. Every class gets the member with the fewest oddities,
the least one in binary order among these, and that member is joined back to each text of the class.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.runtime import Spool, task_slots

# Letters of other scripts drawn like Latin ones, and the Latin letters.
_ALIKE = {
    "аеорсхуіѕјһԁԛԝӏ": "aeopcxyisjhdqwl",
    "АВЕКМНОРСТХІЈЅУԌԚԜҮ": "ABEKMHOPCTXIJSYGQWY",
    "ёїЁЇ": "ëïËÏ",
    "ονϲϳ": "ovcj",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ": "ABEZHIKMNOPTYXCC",
    "όΆΈΉΊΌΎ": "óÁÉHÍÓÝ",
}
_HYPHENS = "‐‑﹣⁃"

# The code points that Unicode lists as default-ignorable, as ranges.
_IGNORABLE = "AD-AD 34F-34F 61C-61C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164-3164 FE00-FE0F FEFF-FEFF FFA0-FFA0 FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF"
_INVISIBLE = {c for r in _IGNORABLE.split() for c in range(int(r.split("-")[0], 16), int(r.split("-")[1], 16) + 1)}

_BINS = 8192


def _tables() -> tuple[dict[str, str], dict[str, str], str]:
    """Single characters mapped to one, characters mapped to several, characters that vanish; by rule from the character database."""
    one, many, gone, private = {}, {}, [], 0xE000
    for code in (*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0x20000), *range(0xE0000, 0xE1000)):
        c = chr(code)
        kind, name, parts = unicodedata.category(c), unicodedata.name(c, ""), unicodedata.decomposition(c)
        if kind == "Zs":
            one[c] = " "
        elif kind == "Cc" or "FILLER" in name or kind == "Cf" and not name.startswith(("ARABIC", "SYRIAC", "KAITHI")) or code in _INVISIBLE:
            gone.append(c)
        elif parts and not parts.startswith("<") and " " not in parts:
            one[c] = unicodedata.normalize("NFC", c)  # another code of the same character
        elif parts.startswith(("<wide>", "<narrow>")):
            plain = unicodedata.normalize("NFKC", c)
            (one if len(plain) == 1 else many)[c] = plain
        elif parts.startswith("<compat>") and "LATIN" in name and ("LIGATURE" in name or code in range(0x1C4, 0x1CD) or code in range(0x1F1, 0x1F4)):
            many[c] = "".join(unicodedata.normalize("NFKC", c))
        elif kind == "Nd":
            one[c], private = chr(private), private + 1  # digits of other scripts stay apart, which the collation takes as equal
    one |= dict.fromkeys(_HYPHENS, "-")
    return one, many, "".join(gone)


_ONE, _MANY, _GONE = _tables()
_LETTERS = {a: b for x, y in _ALIKE.items() for a, b in zip(x, y, strict=True)}
for _c in map(chr, range(0x370, 0x530)):  # accented letters follow their base, as the collation takes them apart
    _base, _marks = unicodedata.normalize("NFD", _c)[0], unicodedata.normalize("NFD", _c)[1:]
    if _marks and _base in _LETTERS and _c not in _LETTERS:
        _plain = unicodedata.normalize("NFC", _LETTERS[_base] + _marks)
        (_LETTERS if len(_plain) == 1 else _MANY)[_c] = _plain


def _mapped(text: Column, one: dict[str, str]) -> Column:
    for c, plain in _MANY.items():
        text = F.replace(text, F.lit(c), F.lit(plain))
    return F.translate(text, "".join(one) + _GONE, "".join(one.values()))


def plain(text: Column) -> Column:
    """Printable ASCII: such texts look alike only if they are the same."""
    return text.rlike(r"^[\x09\x0A\x0D\x20-\x7E]*$")


def look(text: Column) -> Column:
    """The text with characters drawn alike made equal. Plain texts pass as they are."""
    return F.when(plain(text), text).otherwise(_mapped(text, _ONE | _LETTERS))


def _oddities(text: Column) -> Column:
    odd = "".join(_ONE) + "".join(_MANY) + _GONE
    mixed = r"\p{IsLatin}[\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}]\p{IsLatin}|[\p{IsCyrillic}][\p{IsGreek}]|[\p{IsGreek}][\p{IsCyrillic}]"
    return F.when(plain(text), 0).otherwise(F.length(text) - F.length(F.translate(text, odd, "")) + F.regexp_count(text, F.lit(mixed)) + F.regexp_count(text, F.lit(r"\p{Mn}")))


def classes(literals: DataFrame) -> DataFrame:
    """lex, canonical, n_rows, members: the distinct texts that other texts may look like; members counts the texts of a class.

    Null texts belong to no class. Equal texts combine before they move, so a text that fills a third of the rows is one row
    per map task; a class then has one row per way of writing. A plain text that no other text is mapped to is alone in its class
    and is left out, which spares most texts the collation.
    """
    spark = literals.sparkSession
    texts = literals.where("lex IS NOT NULL").groupBy("lex").agg(F.count(F.lit(1)).alias("n_rows"))
    odd = Spool(spark).write(texts.where(~plain(F.col("lex"))).select("lex", "n_rows", look(F.col("lex")).alias("look"), _oddities(F.col("lex")).alias("odd")))
    met = spark.sql(
        """SELECT t.lex, t.n_rows FROM {plain_texts} t LEFT SEMI JOIN {looks} o ON t.lex COLLATE UNICODE = o.look COLLATE UNICODE""",
        plain_texts=texts.where(plain(F.col("lex"))),
        looks=odd.select("look").distinct(),
    )
    variants = odd.union(met.select("lex", "n_rows", F.col("lex").alias("look"), F.lit(0).alias("odd")))
    grouped = spark.sql(
        """SELECT look COLLATE UNICODE AS look_key, min_by(lex, struct(odd, lex)) AS canonical, count(*) AS members
           FROM {variants} GROUP BY look COLLATE UNICODE""",
        variants=variants,
    )
    return spark.sql(
        """SELECT v.lex, c.canonical, v.n_rows, c.members FROM {variants} v JOIN {grouped} c ON v.look COLLATE UNICODE = c.look_key""",
        variants=variants,
        grouped=grouped,
    )


def _salted(rows: DataFrame, per_text: DataFrame, salts: int, how: str) -> DataFrame:
    """rows joined with per_text (_lex, ...) by text; a text that many of the rows have meets ``salts`` copies of its row.

    Hot are the texts of those hash bins that hold more than one ``salts``-th of the rows, so at most ``salts`` of ``_BINS``; all
    other texts have one row. Sizes on disk don't tell how large copies become in memory, so they are never broadcast.
    """
    place = lambda text: F.pmod(F.xxhash64(text), F.lit(_BINS))
    bins = {r.b: r.n for r in rows.groupBy(place("lex").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most _BINS rows
    total = sum(bins.values())
    hot = [b for b, n in bins.items() if n * salts > total]
    copies = per_text.withColumn("_salt", F.explode(F.when(place("_lex").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    salt = F.pmod(F.xxhash64("literal_id", F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    spread = rows.withColumn("_s", F.when(place("lex").isin(hot), salt).otherwise(0))
    return spread.join(copies.hint("merge"), (spread["lex"] == copies["_lex"]) & (spread["_s"] == copies["_salt"]), how)


def canonical_texts(literals: DataFrame, salts: int | None = None) -> DataFrame:
    """literal_id, lex, canonical: equal looks get equal canonical texts, different looks keep different ones; null stays null.

    Texts that are the only writing of their class are their own canonical form and take no part in the join back; the hot
    texts among the rest are spread over ``salts`` copies of their class row, by default as many as there are reduce tasks.
    """
    several = classes(literals).where("lex <> canonical").select(F.col("lex").alias("_lex"), "canonical")
    joined = _salted(literals.select("literal_id", "lex"), several, salts or max(32, task_slots(literals.sparkSession)), "left")
    return joined.select("literal_id", "lex", F.coalesce("canonical", "lex").alias("canonical"))


def look_classes(literals: DataFrame) -> DataFrame:
    """canonical, n_writings, n_rows: the classes of several writings. With canonical_texts it holds all that the pairs of rows
    say, in a size that follows the rows."""
    several = classes(literals).where("members > 1")
    return several.groupBy("canonical").agg(F.count(F.lit(1)).alias("n_writings"), F.sum("n_rows").alias("n_rows"))


def same_look_pairs(literals: DataFrame, block: int = 1000, salts: int | None = None) -> DataFrame:
    """literal_id_a < literal_id_b: rows whose texts look the same and differ in their characters. Rows without an id take no part.

    Only classes with several writings are joined. The rows of each writing are cut into blocks of about ``block`` rows, each
    block of a writing meets each block of the class's other writings, and a join key is one block: no task gets more than a
    few blocks, and rows are copied no more often than they have partners. Rows that share an id and have several writings of a
    class may give a pair more than once.
    """
    spark = literals.sparkSession
    spool = Spool(spark)
    several = classes(literals).where("members > 1").select("lex", F.col("canonical").alias("cls"), F.ceil(F.col("n_rows") / block).cast("int").alias("parts"))
    several = spool.write(several.withColumn("no", F.monotonically_increasing_id()))  # from here on a writing is its number
    rows = literals.where("literal_id IS NOT NULL AND lex IS NOT NULL").select("literal_id", "lex")
    found = _salted(rows, several.select(F.col("lex").alias("_lex"), "no", "parts"), salts or max(32, task_slots(spark)), "inner")
    placed = spool.write(found.select("literal_id", "no", F.pmod(F.xxhash64("literal_id"), F.col("parts")).cast("int").alias("part")).distinct())
    one, two = (several.select(*[F.col(c).alias(f"{c}_{x}") for c in ("no", "cls", "parts")]) for x in "ab")
    meet = one.join(two.hint("merge"), (F.col("cls_a") == F.col("cls_b")) & (F.col("no_a") < F.col("no_b"))).select("no_a", "no_b", "parts_a", "parts_b")
    for x in "ab":
        meet = meet.withColumn(f"part_{x}", F.explode(F.sequence(F.lit(0), F.col(f"parts_{x}") - 1))).drop(f"parts_{x}")
    a, b = (placed.select(F.col("literal_id").alias(f"id_{x}"), F.col("no").alias(f"n_{x}"), F.col("part").alias(f"p_{x}")) for x in "ab")
    half = a.join(meet.hint("merge"), (F.col("n_a") == F.col("no_a")) & (F.col("p_a") == F.col("part_a"))).select("id_a", "no_b", "part_b")
    pairs = half.join(b.hint("merge"), (F.col("no_b") == F.col("n_b")) & (F.col("part_b") == F.col("p_b"))).where("id_a <> id_b")
    return pairs.select(F.least("id_a", "id_b").alias("literal_id_a"), F.greatest("id_a", "id_b").alias("literal_id_b"))
