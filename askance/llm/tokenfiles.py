"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped reading.

A data set is a folder of parts. Part k holds the documents of one range of doc_id, in order:
``part-k.ids`` the ids of all its documents (unsigned, little-endian, two bytes each where the vocabulary
allows it, else four), ``part-k.off`` one unsigned 64-bit offset per document and the end (in ids, from
the part's start), ``part-k.doc`` the documents' signed 64-bit doc_ids and one byte each for whether it
has one. The manifest lists the parts with their documents and ids; a part's base, the number of ids
before it, is the prefix sum over the manifest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_shared, write_shared
from .tokens import encoder

END_ID = 1
MANIFEST = "part int, docs bigint, tokens bigint, width int"
#: Bytes of ids that a part's writer holds before they go to the file.
_FLUSH = 8 << 20


def _writer(folder: str, path: str, end: int):
    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), encoder(path)
        width = 4 if own.wide else 2
        tail, offsets, docs, total = np.array([end], f"<u{width}").tobytes(), [0], [], 0

        def ids():
            nonlocal total
            held = bytearray()
            for batch in batches:
                for doc, body in zip(batch.column(0).to_pylist(), own.packed(batch.column(1))):
                    body = body.as_py()
                    held += body
                    held += tail
                    total += len(body) // width + 1
                    offsets.append(total)
                    docs.append(doc)
                    if len(held) >= _FLUSH:
                        yield bytes(held)
                        held.clear()
            yield bytes(held)

        name = f"{folder}/part-{part:06d}"
        write_shared(f"{name}.ids", ids())
        if not docs:
            return
        write_shared(f"{name}.off", [np.array(offsets, "<u8").tobytes()])
        has = np.array([d is not None for d in docs], "u1")
        write_shared(f"{name}.doc", [np.array([d or 0 for d in docs], "<i8").tobytes(), has.tobytes()])
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "docs": len(docs), "tokens": total, "width": width}],
            schema=pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("width", pa.int32())]),
        )

    return write


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each and write the ids to ``folder``.

    Documents lie in ascending doc_id order, those without an id first; rows with one id are ordered by
    their text, so the files are the same whichever task wrote them. Texts are ranged by (doc_id, hash of
    text), so that one id given very often still spreads, and encoded behind the exchange: finding the
    ranges reads the input once more but encodes nothing. Null and empty texts are the end id alone.
    Returns the manifest: a row per part.
    """
    spark = docs.sparkSession
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    rows = docs.select("doc_id", "text")
    ranged = rows.repartitionByRange(parts, *keys[:2]) if parts else rows.repartitionByRange(*keys[:2])
    manifest = ranged.sortWithinPartitions(*keys).mapInArrow(_writer(folder, path, end_id), MANIFEST)
    rows = manifest.collect()  # a row per part, not per document
    return spark.createDataFrame(sorted(rows, key=lambda r: r["part"]), MANIFEST)


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the memory-mapped files.

    ``start`` is the number of ids of all documents before, ``n_tokens`` counts the end id too, and
    ``ids_crc32`` is the CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    base, tasks = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        tasks.append((r["part"], r["docs"], r["width"], base))
        base += r["tokens"]
    parts = spark.createDataFrame(tasks, "part int, docs bigint, width int, base bigint")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            for part, docs, width, base in frame.itertuples(index=False):
                name = f"{folder}/part-{part:06d}"
                with open_shared(f"{name}.ids") as f, open_shared(f"{name}.off") as o, open_shared(f"{name}.doc") as d:
                    offsets = np.frombuffer(o.read(), "<u8").astype(np.int64)
                    raw = d.read()
                    doc_ids = np.frombuffer(raw, "<i8", count=docs)
                    has = np.frombuffer(raw, "u1", offset=8 * docs) == 1
                    for lo in range(0, docs, 4096):
                        ends = offsets[lo : lo + 4097]
                        sums = []
                        for first, last in zip(ends[:-1], ends[1:]):
                            f.seek(int(first) * width)
                            ids = np.frombuffer(f.read(int(last - first) * width), f"<u{width}")
                            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        rows = slice(lo, lo + len(sums))
                        yield pd.DataFrame(
                            {
                                "doc_id": pd.Series(doc_ids[rows], dtype="Int64").where(has[rows]),
                                "start": base + ends[:-1],
                                "n_tokens": np.diff(ends),
                                "ids_crc32": np.array(sums, np.int64),
                            }
                        )

    dealt = parts.repartition(max(1, len(tasks)), "part") if tasks else parts
    return dealt.mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
