"""Token counts from flat token files by a separator scan.

Method. A token file is nothing but token identifiers, little-endian and of fixed width, with the
end-of-document identifier after each document; it has no index. Files are cut into blocks of equal
size, read at their offsets in parallel. One vectorised search finds the separators of a block; the
block returns its lengths between separators and where its first and last ones are. A prefix scan over
the blocks of a file gives each the number of separators before it and the place of the last of them,
which is all that is needed to number the documents and to measure the one that spans a boundary.

Long texts are tokenised in pieces, cut where the pattern always ends a piece: before white space that follows something
else. A long run of white space is one piece by the pattern, or all but its last character where more follows, and is
merged as such, as the pattern's search would need a stack as deep as the run.

Edge cases. A vocabulary that holds the separator, or numbers too large for the files, is refused. A null or empty text is a document of 0 tokens. Tokens after a file's last separator are a
document of their own, marked as not ``complete``. Empty files and tables give no rows. Repeated rows
are repeated documents.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import new_path, small_batches, stash

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# A fixed value: how GPT-2 style byte-level vocabularies cut text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = 50256
DTYPE = "<u2"


# A fixed value: the characters that the pattern takes as white space.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<=[^{_SPACES}])(?=[{_SPACES}])")
_RUN = re.compile(f"[{_SPACES}]{{1000,}}")


def _encoding(vocabulary: str, separator: int = SEPARATOR, dtype: str = DTYPE):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    if separator in ranks.values() or max(separator, *ranks.values()) > np.iinfo(dtype).max:
        raise ValueError(f"{vocabulary} holds the separator {separator}, or numbers that {dtype} does not")
    return tiktoken.Encoding("flat", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def encode(encoding, text: str, step: int = 1 << 18) -> Iterator[list[int]]:
    """The tokens of a text, piece by piece, as ``encode_ordinary`` would give them for the whole."""
    at = 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from _between_runs(encoding, text, at, run.start(), step)
        yield encoding._encode_single_piece(text[run.start() : end])
        at = end
    yield from _between_runs(encoding, text, at, len(text), step)


def _between_runs(encoding, text: str, at: int, end: int, step: int) -> Iterator[list[int]]:
    while at < end:
        cut = _CUT.search(text, min(at + step, end), end) if end - at > step else None
        stop = cut.start() if cut else end
        yield encoding.encode_ordinary(text[at:stop])
        at = stop


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """Writes ``docs(doc_id, text)`` as flat token files, one per task, and returns ``(file, ordinal, doc_id)``.

    Each attempt of a task writes a file of its own name; only files in the returned table count, so a
    lost or repeated attempt leaves an unread file and nothing else. The table must be stashed once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary, separator, dtype)
        name = f"{folder}/{uuid.uuid4().hex}.tokens"
        fs, path = pa.fs.FileSystem.from_uri(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        ordinal, end = 0, np.array([separator], dtype=dtype).tobytes()
        with fs.open_output_stream(path) as out:
            for batch in batches:
                for text in batch.column(1):
                    for ids in encode(encoding, text.as_py() or ""):
                        out.write(np.array(ids, dtype=dtype).tobytes())
                    out.write(end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0).cast(pa.int64())], names=["file", "ordinal", "doc_id"])
                ordinal += n

    return docs.select("doc_id", "text").mapInArrow(write, "file string, ordinal long, doc_id long")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, bytes)`` of the token files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def scan_blocks(files: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE, block_bytes: int = 1 << 21) -> DataFrame:
    """``(file, block, n_seps, first_sep, last_sep, end, gaps)`` of each block of ``files(file, bytes)``.

    Places count tokens from the file's start; ``gaps`` are the lengths between the block's separators.
    """
    width = np.dtype(dtype).itemsize
    step = block_bytes - block_bytes % width
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))).alias("block"))
    schema = "file string, block long, n_seps long, first_sep long, last_sep long, end long, gaps array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(row["file"])
                with fs.open_input_file(path) as f:
                    raw = f.read_at(min(step, row["bytes"] - row["block"] * step), row["block"] * step)
                ids = np.frombuffer(raw, dtype=dtype, count=len(raw) // width)
                at = np.flatnonzero(ids == separator) + row["block"] * (step // width)
                rows.append(
                    {"file": row["file"], "block": row["block"], "n_seps": len(at), "first_sep": int(at[0]) if len(at) else None, "last_sep": int(at[-1]) if len(at) else None}
                    | {"end": row["block"] * (step // width) + len(ids), "gaps": (np.diff(at) - 1).tolist()}
                )
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), *[(c, pa.int64()) for c in ("block", "n_seps", "first_sep", "last_sep", "end")], ("gaps", pa.list_(pa.int64()))]))

    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(n, "file", "block").mapInArrow(scan, schema)


def document_lengths(blocks: DataFrame) -> DataFrame:
    """``(file, ordinal, n_tokens, complete)`` from stashed blocks: the prefix scan and the stitching."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocks.select(
        "file",
        "block",
        F.coalesce(F.sum("n_seps").over(before), F.lit(0)).alias("ordinal"),
        F.coalesce(F.max("last_sep").over(before), F.lit(-1)).alias("since"),
    )
    inner = blocks.where("n_seps > 0").join(scanned, ["file", "block"])
    lengths = F.concat(F.array(F.col("first_sep") - F.col("since") - 1), "gaps")
    whole = inner.select("file", "ordinal", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("complete"))
    ends = blocks.groupBy("file").agg(F.sum("n_seps").alias("ordinal"), (F.max("end") - F.coalesce(F.max("last_sep"), F.lit(-1)) - 1).alias("n_tokens"))
    return whole.unionByName(ends.where("n_tokens > 0").withColumn("complete", F.lit(False)))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = 1 << 21) -> DataFrame:
    """``(doc_id, n_tokens)``: tokenises ``docs`` into flat files of the shared folder and scans those."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_path(spark, "token-files")
    manifest, _ = stash(write_token_files(docs, folder, vocabulary), "token-manifest")
    name = F.substring_index("file", "/", -1)
    named = manifest.select(name.alias("file"), "ordinal", "doc_id")
    files = token_files(spark, folder).withColumn("name", name).join(named.select(F.col("file").alias("name")).distinct(), "name").select("file", "bytes")
    blocks, _ = stash(scan_blocks(files, block_bytes=block_bytes), "token-blocks")
    lengths = document_lengths(blocks).select(name.alias("file"), "ordinal", "n_tokens")
    return named.join(lengths, ["file", "ordinal"]).select("doc_id", "n_tokens")
