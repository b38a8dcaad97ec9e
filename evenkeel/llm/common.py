"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

MASK64 = (1 << 64) - 1

#: How many distinct words a Python worker remembers before it starts afresh.
WORDS_KEPT = 400_000


class WordHashes(dict):
    """Word (``bytes``) -> XXH64; forgets everything when it has grown to ``WORDS_KEPT`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: StructType,
    make: Callable[[], Callable[..., list]],
) -> DataFrame:
    """Add the columns ``fields`` to every row of ``df`` by a function over Arrow columns.

    ``make()`` runs once per task and returns a function from lists of the ``inputs`` values to one list
    per field. A column of ``df`` that has the name of a field is replaced, unless it is an input; then
    the names clash and ``ValueError`` is raised. Rows are neither moved nor reordered.
    """
    if clash := set(inputs) & set(fields.names):
        raise ValueError(f"input columns named like outputs: {sorted(clash)}")
    df = df.select(*[df[c] for c in df.columns if c not in fields.names])
    schema = StructType([*df.schema.fields, *fields.fields])
    from pyspark.sql.pandas.types import to_arrow_schema
    wanted = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            outs = work(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs])
            arrays = [pa.array(o, type=f.type) for o, f in zip(outs, wanted, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *wanted.names])

    return df.mapInArrow(run, schema)
