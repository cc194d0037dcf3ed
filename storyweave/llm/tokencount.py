"""Token counts of documents in flat token files: a separator scan.

A flat file is nothing but token ids, 16 bits each, a document after the other,
each followed by the end-of-document id; there is no index. Files are cut into
blocks, a task looks for the separators of a block with one vectorised
comparison, and a running last-separator over the blocks of a file, a prefix
scan over one row per block, stitches documents that cross block borders.

Files are read and written with pyarrow, so their folder must be a URI that
pyarrow knows and driver and executors share.

Defined cases: a null or empty text is a document of no tokens, its separator
alone; an empty folder has no documents; tokens after a file's last separator
are a last document that isn't ``closed``; a null doc_id is carried; repeated
rows are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyweave.llm.batches import Step, map_batches
from storyweave.llm.tokens import Encoder
from storyweave.session import checkpoint_root, cut_lineage

END = 50_256
RANKS = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 8 << 20


def _uri(folder: str) -> str:
    return "file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file:///") else folder


def shared_folder(spark: SparkSession) -> str:
    return _uri(f"{checkpoint_root(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}")


def write_files(docs: DataFrame, folder: str, ranks: str = RANKS, end: int = END) -> DataFrame:
    """Writes a flat file per task to ``folder`` and returns (file, ordinal,
    doc_id), which only labels results. A task writes under a name of its own
    and renames at the end, so a repeated task replaces its file whole."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, done = TaskContext.get(), Encoder(ranks), 0
        target, at = fs.FileSystem.from_uri(folder)
        number = task.partitionId()
        own = f"{at}/_{number}-{task.taskAttemptId()}"
        separator = np.array([end], "<u2")
        with target.open_output_stream(own) as out:
            for batch in batches:
                for ids in encoder.encode(batch.column("text")):
                    if len(ids) and ids.max() > 0xFFFF:
                        raise ValueError(f"token id {ids.max()} of {ranks} has no place in a file of 16-bit ids")
                    out.write(np.concatenate((ids.astype("<u2"), separator)).tobytes())
                n = batch.num_rows
                yield pa.record_batch(
                    [pa.array(np.full(n, number, np.int32)), pa.array(np.arange(done, done + n)), batch.column("doc_id")], names=["file", "ordinal", "doc_id"])
                done += n
        target.move(own, f"{at}/part-{number:06d}.bin")

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file int, ordinal long, doc_id long")
    return cut_lineage(rows)


def documents_in(spark: SparkSession, folder: str, end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, start, n_tokens and closed of every document in the flat
    files of ``folder``; the separator is not counted."""
    if block_bytes % 2:
        raise ValueError("a block holds whole ids")
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bin").load(folder)
        .select(F.col("path"), "length", F.regexp_extract("path", r"part-(\d+)\.bin$", 1).cast("int").alias("file"))
        .where(F.col("length") > 0)
    )
    last_block = F.floor((F.col("length") - 1) / block_bytes).cast("long")
    blocks = files.select("path", "file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("block")).repartition("file", "block")

    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ends, counts = [], []
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(_uri(path))
                with store.open_input_file(at) as source:
                    source.seek(block * block_bytes)
                    ids = np.frombuffer(source.read(block_bytes), "<u2")
                counts.append(len(ids))
                ends.append(np.flatnonzero(ids == end) + block * (block_bytes // 2))
            return pa.record_batch(
                [batch.column("file"), batch.column("block"), pa.array(counts, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

        return step

    found = cut_lineage(map_batches(blocks, make, "file int, block long, n long, ends array<long>"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    stitched = found.select(
        "file", "ends",
        F.coalesce(F.last(F.when(F.size("ends") > 0, F.element_at("ends", -1)), ignorenulls=True).over(before) + 1, F.lit(0)).alias("carry"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("earlier"),
    )
    closed = stitched.select("file", "carry", "earlier", "ends", F.posexplode("ends").alias("at", "stop")).select(
        "file", (F.col("earlier") + F.col("at")).alias("ordinal"),
        F.when(F.col("at") == 0, F.col("carry")).otherwise(F.get("ends", F.col("at") - 1) + 1).alias("start"), "stop",
    ).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"))
    # what follows the last separator of a file
    tails = found.groupBy("file").agg(
        F.sum("n").alias("total"), F.coalesce(F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)) + 1, F.lit(0)).alias("start"), F.sum(F.size("ends")).alias("ordinal"),
    ).where(F.col("total") > F.col("start")).select("file", "ordinal", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tails)


def count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and n_tokens by way of flat files: written, scanned, labelled."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    labels = write_files(docs, folder)
    return documents_in(spark, folder, block_bytes=block_bytes).join(labels, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
