"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Texts of up to ``CHUNK`` code points are encoded where they are read. Longer ones are cut into chunks that overlap by
``OVERLAP``; the chunks are pre-tokenised in parallel, neighbours are stitched at the first pre-token boundary on which both
agree (from a common boundary on, both read the text alike), and the pieces between the stitches are encoded in parallel. A text
with neighbours that agree nowhere in their overlap, as in a run of one class of characters longer than it, is encoded whole.
Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quadloom.runtime import Spool, ship, task_slots

CHUNK = 65_536
OVERLAP = 2_048
_FLUSH = 1_000_000

# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """A rank file (base64 token, rank per line) and its pre-token pattern; tasks get the file's bytes, not its path."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.data = f.read()
        self.pattern = pattern

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}

    def encoding(self):
        import tiktoken

        key = hash(self.data)
        if key not in _LOADED:
            _LOADED[key] = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})
        return _LOADED[key]

    def splitter(self):
        """The pattern for the regex module, whose \\s has control characters that White_Space has not."""
        import regex

        return regex.compile(self.pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


_LOADED: dict = {}


def _encode(enc, text: str) -> np.ndarray:
    return np.asarray(enc.encode_to_numpy(text, disallowed_special=()), dtype=np.int32)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))


def _emit(cols: list[pa.Array], rows: list[int], parts: list, counting: bool, names: list[str]) -> pa.RecordBatch:
    last = pa.array(parts, pa.int64()) if counting else _lists(parts)
    taken = [c.take(pa.array(rows, pa.int64())) for c in cols]
    return pa.RecordBatch.from_arrays([*taken, last], names=names)


def _encoder(shared, text_at: int, keep: list[int], names: list[str], counting: bool):
    """For mapInArrow: text column text_at becomes ids or their number; columns keep are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value.encoding()
        for batch in batches:
            cols, texts = [batch.column(i) for i in keep], batch.column(text_at)
            rows, parts, size = [], [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                ids = _encode(enc, text) if text else np.empty(0, np.int32)
                rows.append(i)
                parts.append(len(ids) if counting else ids)
                size += len(ids)
                if size > _FLUSH:
                    yield _emit(cols, rows, parts, counting, names)
                    rows, parts, size = [], [], 0
            if rows:
                yield _emit(cols, rows, parts, counting, names)

    return run


def _cutter(chunk: int, overlap: int):
    """Rows of text chunks: uid, key, no, start, body. Every chunk but the last carries the overlap with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                for no, start in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([no], pa.int32()), pa.array([start], pa.int64()), pa.array([text[start : start + chunk + overlap]], pa.string())],
                        names=["uid", "key", "no", "start", "body"],
                    )

    return run


def _boundaries(shared, chunk: int, overlap: int):
    """uid, no, start, head, tail: pre-token boundaries in the first and in the last overlap, as positions in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = shared.value.splitter()
        for batch in batches:
            heads, tails = [], []
            for i in range(batch.num_rows):
                start, body = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                # white space looks ahead, so a piece must not end with it
                ends = [m.end() for m in split.finditer(body) if not m.group()[-1].isspace()]
                # what ends the chunk may go on in the text, so the last two boundaries prove nothing
                inner = ends[:-2] if len(body) > chunk else ends
                heads.append([start + e for e in ends[:-2] if 0 < e <= overlap])
                tails.append([start + e for e in inner if e > chunk])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=["uid", "no", "start", "head", "tail"])

    return run


def _long_texts(rows: DataFrame, shared, chunk: int, overlap: int, counting: bool) -> DataFrame:
    """rows: key, text; texts longer than a chunk."""
    spark = rows.sparkSession
    key = rows.schema["key"].dataType
    tasks = task_slots(spark)
    # long texts are written once: numbers given again in another run of the plan could name other rows
    uids = Spool(spark).write(rows.select(F.monotonically_increasing_id().alias("uid"), "key", "text"))
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("key", key), T.StructField("no", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("body", T.StringType())])
    chunks = uids.mapInArrow(_cutter(chunk, overlap), schema).repartition(tasks, "uid", "no")
    ends = chunks.select("uid", "no", "start", "body").mapInArrow(_boundaries(shared, chunk, overlap), "uid bigint, no int, start bigint, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("uid").orderBy("no")
    agreed = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    cuts = ends.select("uid", "no", "start", F.when(F.col("no") == 0, F.lit(0)).otherwise(agreed).alias("cut"))
    cuts = cuts.select("uid", "no", "start", "cut", F.lead("cut").over(order).alias("until"), F.min(F.col("cut").isNotNull()).over(Window.partitionBy("uid")).alias("agree"))
    # the last boundary of a text is its end: until stays null there
    fine = chunks.join(cuts.drop("start").hint("shuffle_hash"), ["uid", "no"])
    piece = F.when(F.col("agree"), F.expr("substring(body, int(cut - start) + 1, int(coalesce(until, start + length(body)) - cut))")).otherwise(F.lit(None))
    pieces = fine.where("agree").select("uid", "key", "no", piece.alias("text"))
    whole = uids.join(cuts.where("no = 0 AND NOT agree").select("uid"), "uid", "left_semi").select("uid", "key", F.lit(0).alias("no"), "text")
    out = T.StructType([T.StructField("uid", T.LongType()), T.StructField("key", key), T.StructField("no", T.IntegerType()), T.StructField("out", T.LongType() if counting else T.ArrayType(T.IntegerType()))])
    encoded = pieces.union(whole).mapInArrow(_encoder(shared, 3, [0, 1, 2], ["uid", "key", "no", "out"], counting), out)
    if counting:
        return encoded.groupBy("uid").agg(F.first("key").alias("key"), F.sum("out").alias("out")).select("key", "out")
    joined = encoded.groupBy("uid").agg(F.first("key").alias("key"), F.sort_array(F.collect_list(F.struct("no", "out"))).alias("parts"))
    return joined.select("key", F.flatten("parts.out").alias("out"))


def encode_table(df: DataFrame, key: str, text: str, tokenizer: Tokenizer, counting: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids) of every row, without special tokens, or (key, n_tokens). Empty and null texts get the empty list (0 tokens).

    Strings that look like special tokens are ordinary text. Rows with equal keys stay rows of their own; keys may be null. Only
    the two named columns are read.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    spark = ship(df.sparkSession)
    shared = spark.sparkContext.broadcast(tokenizer)  # one vocabulary file
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    name = "n_tokens" if counting else "ids"
    out = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("out", T.LongType() if counting else T.ArrayType(T.IntegerType()))])
    short = rows.where(f"text IS NULL OR length(text) <= {chunk}").mapInArrow(_encoder(shared, 1, [0], ["key", "out"], counting), out)
    long = _long_texts(rows.where(f"length(text) > {chunk}"), shared, chunk, overlap, counting)
    return short.union(long).select(F.col("key").alias(key), F.col("out").alias(name))


def decode_table(df: DataFrame, key: str, ids: str, tokenizer: Tokenizer) -> DataFrame:
    """(key, text): the ids' bytes, concatenated and read as UTF-8 (invalid sequences become U+FFFD); null ids give null."""
    shared = ship(df.sparkSession).sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value.encoding()
        for batch in batches:
            texts = [None if v is None else enc.decode_bytes(v).decode("utf-8", "replace") for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).select(F.col("key").alias(key), "text")
