"""What the operators share: narrow inputs, Arrow maps, and codepoint arrays of many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` as just the given columns: result name = column of ``df``, cast-free.

    Operators rename their input this way first, so further columns of any name cannot clash.
    """
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def arrow_map(df: DataFrame, work: Callable[[Batches], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``work`` yields column dictionaries (arrays or lists) in ``schema``'s order."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Batches) -> Batches:
        for columns in work(batches):
            arrays = [pa.array(columns[f.name], type=f.type) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str = "text", chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``chars`` bytes of text (one row at least), to bound memory.

    ``text`` may also be a column of the texts' sizes.
    """
    column = batch.column(text)
    lengths = column if pa.types.is_integer(column.type) else pa.compute.binary_length(column)
    sizes = np.array(lengths.fill_null(0).to_numpy(zero_copy_only=False))
    cell = np.cumsum(sizes, dtype=np.int64) // chars
    edges = np.flatnonzero(np.diff(cell)) + 1
    start = 0
    for end in [*edges.tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def text_runs(texts: list[str], chars: int = 1 << 18, overlap: int = 0) -> Iterator[tuple[list[int], list[str], bool, bool]]:
    """``texts`` in runs of about ``chars`` characters: row numbers, pieces, and whether a run begins and
    ends its texts.

    Short texts share a run. A longer one comes as pieces of its own, in order, of which each starts
    with the last ``overlap`` characters of the one before. So no array over a run grows with a text.
    """
    rows: list[int] = []
    pieces: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        if rows and held + len(text) > chars:
            yield rows, pieces, True, True
            rows, pieces, held = [], [], 0
        if len(text) <= chars:
            rows.append(row)
            pieces.append(text)
            # Framing costs a few places a text, so empty texts count too.
            held += len(text) + 4
            continue
        for start in range(0, len(text) - overlap, chars):
            end = min(len(text), start + chars + overlap)
            yield [row], [text[start:end]], start == 0, end == len(text)
    if rows:
        yield rows, pieces, True, True
