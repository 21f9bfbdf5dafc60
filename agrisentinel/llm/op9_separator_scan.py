"""Token counts by scanning flat token files for the end-of-document id.

``write_token_files`` encodes texts with a public tokenizer into flat files of
big-endian 16-bit ids, one ``EOD`` after each document and no index.
``scan_token_files`` reads them back as fixed-size blocks, searches each block's
ids for ``EOD`` in one vector operation, and stitches documents that run over
block boundaries with a segmented prefix scan: what a block leaves open after its
last separator is carried to the next separator of the file.

The separator's two bytes are a character of their own in UTF-8 (U+0100), which
is what Spark's text writer puts after each record; ids of the vocabularies used
are below it.

Null and empty texts are documents of 0 tokens.  Repeated rows are documents of
their own.  Texts of any length are encoded in pieces cut at white space.  The
n-th document of a file is the n-th row of the partition that wrote it, so
``document_tokens`` reads a scan of stored files as it is; a frame that a shuffle
deals is stored first.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .tables import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EOD = 0xC480  # big-endian bytes C4 80, U+0100 in UTF-8; ids of the vocabulary are below 50,257
BLOCK_BYTES = 1 << 20
PIECE = 1 << 16  # characters encoded at once
# Fixed value: the word pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a rank file, once per worker process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encode(text: str, path: str = TOKENIZER) -> np.ndarray:
    """Ids of a text.  A text longer than PIECE is cut before a blank that follows
    a letter, where the pattern begins a new word anyway."""
    enc, out, at = encoder(path), [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1: end + 2].isalpha()):
            end += 1
        out += enc.encode_ordinary(text[at:end])
        at = end
    return np.array(out, np.int64)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for i in range(0, len(column), 256):
                texts = column.slice(i, 256).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([encode(t or "", path).astype(">u2").tobytes() for t in texts], pa.binary())], names=["ids"])
    return run


def write_token_files(docs: DataFrame, folder: str, text_col: str = "text", tokenizer: str = TOKENIZER) -> None:
    """One flat token file per partition of ``docs`` (none for an empty one)."""
    ids = docs.select(F.col(text_col).alias("text")).mapInArrow(_encode(tokenizer), "ids binary")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", chr(0x100)).text(folder)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Separators of each block: gaps between them, and what lies before and after."""
    for batch in batches:
        head, tail, found, inner = [], [], [], []
        for i in range(batch.num_rows):
            ids = np.frombuffer(batch.column(2)[i].as_buffer(), ">u2")
            at = np.flatnonzero(ids == EOD)
            found.append(len(at))
            head.append(int(at[0]) if len(at) else len(ids))
            tail.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
            inner.append(np.diff(at) - 1)
        sizes = np.array([len(x) for x in inner], np.int64)
        flat = np.concatenate(inner) if inner else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.int64()), pa.array(head, pa.int64()),
             pa.array(tail, pa.int64()), lists], names=["file", "block", "found", "head", "tail", "inner"])


def scan_token_files(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, ordinal, n_tokens``: the documents of each file in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    cuts = F.expr(f"""transform(sequence(0, greatest(cast(ceil(length(content) / {block_bytes}D) as int) - 1, 0)),
                      i -> substring(content, i * {block_bytes} + 1, {block_bytes}))""")
    name = F.element_at(F.split("path", "/"), -1)
    blocks = files.where("length > 0").select(name.alias("file"), F.posexplode(cuts).alias("block", "ids"))
    found = blocks.mapInArrow(
        _find, "file string, block int, found long, head long, tail long, inner array<int>")
    in_file = Window.partitionBy("file").orderBy("block")  # a row per block of one file
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({
        "seen": F.coalesce(F.sum("found").over(before), F.lit(0)),
        # blocks since a separator, that block's tail included, form a segment
        "segment": F.sum((F.col("found") > 0).cast("long")).over(in_file)})
    upto = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("pending", F.sum("tail").over(upto))
    found = found.withColumn("carry", F.coalesce(F.lag("pending").over(in_file), F.lit(0)))
    sizes = F.concat(F.array((F.col("carry") + F.col("head")).cast("long")), F.col("inner").cast("array<long>"))
    return (found.where("found > 0").select("file", "seen", F.posexplode(sizes).alias("k", "n_tokens"))
                 .select("file", (F.col("seen") + F.col("k")).alias("ordinal"), "n_tokens"))


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, file, ordinal, n_tokens`` of each row of ``docs``."""
    spark = docs.sparkSession
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        # a shuffle may deal rows otherwise when it runs again; a scan of files cannot
        docs = materialise(docs.select(id_col, text_col), "op9-documents")
    folder = scratch_path(spark, "op9-tokens")
    write_token_files(docs, folder, text_col, tokenizer)
    found = scan_token_files(spark, folder)
    row = F.monotonically_increasing_id()  # partition number in the upper bits, row in the lower 33
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).isNull().alias("_"), row.alias("row")).select(
        "doc_id", F.shiftright("row", 33).cast("int").alias("part"), F.col("row").bitwiseAND((1 << 33) - 1).alias("ordinal"))
    found = found.withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
    return ids.join(found, ["part", "ordinal"], "left").select("doc_id", "file", "ordinal", "n_tokens")
