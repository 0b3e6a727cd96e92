"""Arrow passes over texts: one batch in, one batch out, nothing kept between rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: A-Z to a-z, other bytes as they are.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of a batch's texts up to which a kernel gets them at once.
SLICE_BYTES = 4 << 20

#: Bytes of an Arrow batch, both ways; Spark's own bound of 64 MB is in force twice for each task, off the heap.
BATCH_BYTES = "4m"


def small_batches(df: DataFrame) -> DataFrame:
    """Bound Arrow batches for the session, unless it has set a bound of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) in (None, "67108864b"):
        conf.set(key, BATCH_BYTES)
    return df


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of text each, so working memory doesn't grow with the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for n, size in enumerate(sizes):
        if total and total + size > SLICE_BYTES:
            yield batch.slice(begin, n - begin)
            begin, total = n, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null gives an empty text."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def map_texts(docs: DataFrame, columns: Sequence[str], kernel: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Run `kernel` over parts of Arrow batches of `columns`; it returns arrays by output column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(kernel(part))

    return small_batches(docs).select(*columns).mapInArrow(run, schema)
