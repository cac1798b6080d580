"""Token counts from flat token files without an index: a vectorised separator scan.

Token files are runs of little-endian 16-bit ids in which each document ends with the end-of-document id. Each block of
a file is scanned on its own: how many separators it holds, the tokens before the first and after the last, and the
lengths between. A prefix scan over these small rows gives every block the documents and the open tokens before it,
which stitches documents across any number of blocks.

:func:`write_tokens` makes such files from texts with a public tokenizer, one file a task, in the shared folder, on any file
system that Arrow opens (files, hdfs, s3, gs); others raise. An attempt of a task writes a file of its own name, and only the
files named by the attempts that Spark took are read, so lost executors do no harm.

Defined results: null and empty texts have no tokens (count 0); tokens after the last separator of a file count as a last
document; repeated rows each get a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir, table

END, BLOCK_BYTES = 50256, 4 << 20
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoder(path: str = TOKENIZER):
    """The byte-pair encoder of a ranks file; its ids leave ``END`` free."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def storage(uri: str):
    """The file system of a folder and the folder's path there; a path without a scheme is a local one."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.rstrip("/")
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/").rstrip("/")
    found, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))
    return found, path.rstrip("/")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes the texts' tokens and gives (file, ordinal, doc_id), and per file a row of ordinal -1 with its bytes."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["file", "ordinal", "doc_id", "bytes"]

    def run(batches):
        encode = encoder(tokenizer).encode_ordinary
        context = TaskContext.get()
        file = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.tokens"
        files, path = storage(folder)
        name, n, size = f"{folder}/{file}", 0, 0
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/{file}") as out:
            for batch in batches:
                for x in batch.column("text"):
                    ids = np.array(encode(x.as_py()) if x.is_valid else [], np.uint16)
                    out.write(ids.astype("<u2").tobytes() + END.to_bytes(2, "little"))
                    size += 2 * len(ids) + 2
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.array(np.arange(n, n + k)), batch.column("doc_id"), pa.nulls(k, pa.int64())], names)
                n += k
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1]), pa.nulls(1, pa.int64()), pa.array([size])], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"file string, ordinal long, doc_id {kind if kind == 'bigint' else 'long'}, bytes long")


def _scan(width: int):
    def run(batches):
        for batch in batches:
            for file, at, end in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "end"))):
                folder, _, name = file.rpartition("/")
                files, path = storage(folder)
                with files.open_input_file(f"{path}/{name}") as source:
                    ids = np.frombuffer(source.read_at((end - at) // width * width, at), f"<u{width}")
                stop = np.flatnonzero(ids == END)
                n = len(ids)
                head, tail = (stop[0], n - stop[-1] - 1) if len(stop) else (n, n)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at]), pa.array([len(stop)]), pa.array([int(head)]), pa.array([int(tail)]), pa.array([np.diff(stop) - 1], pa.list_(pa.int64()))], ["file", "at", "stops", "head", "tail", "inner"])

    return run


def count_tokens(files: DataFrame, block_bytes: int = BLOCK_BYTES, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the flat files (file, bytes)."""
    block_bytes -= block_bytes % width
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {block_bytes}L)")).alias("at"))
    blocks = blocks.select("file", "at", F.least("bytes", F.col("at") + block_bytes).alias("end")).repartition("file", "at")
    scanned = blocks.mapInArrow(_scan(width), "file string, at long, stops long, head long, tail long, inner array<long>")
    order = Window.partitionBy("file").orderBy("at")
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    x = scanned.withColumn("run", F.sum((F.col("stops") > 0).cast("int")).over(seen)).withColumn("before", F.sum("stops").over(seen) - F.col("stops"))
    x = x.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0))).withColumn("last", F.lead("at").over(order).isNull())
    first = F.array(F.col("carry") + F.col("head"))
    lengths = F.when(F.col("stops") > 0, F.concat(first, "inner")).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("last") & (F.col("open") > 0), F.array("open")).otherwise(F.array().cast("array<long>"))
    return x.select("file", "before", F.posexplode(F.concat(lengths, rest)).alias("k", "n_tokens")).select("file", (F.col("before") + F.col("k")).alias("ordinal"), "n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files of its encoded texts."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    written = checkpointed(write_tokens(table(spark, sf_dir, "documents"), folder))
    counts = count_tokens(written.where("ordinal = -1").select("file", "bytes"))
    return written.where("ordinal >= 0").join(counts.hint("merge"), ["file", "ordinal"], "left").select("doc_id", "n_tokens")
