"""Helpers shared by the operators: columns, Arrow slices, settled tables, numbers of a row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blocktrace.plans.storage import new_folder

#: A word, everywhere in this package; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at once, and that Spark hands to it in one batch.
SLICE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
#: Rows that Spark's Parquet reader decodes at once. Its default of 4,096 whole texts fills a reader's buffers with tens of MB.
READ_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: computed once, safe from lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """`df`, whose rows now reach Python in batches of bounded bytes, and are read in shorter batches too.

    The settings hold for the session; a smaller one that is set already stays.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
                       ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if int(conf.get(name, None) or 2 ** 31 - 1) > most:
            conf.set(name, str(most))
    return df


def slices(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the `columns` (`text`) hold about `limit` bytes; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    for c in columns or ("text",))
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def join_uneven(rows: DataFrame, side: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join with a side of one row per key, whose column `weight` says how many rows have the key.

    A key that holds more than a thousandth of all weighed rows is hot. There
    are less than a thousand of those, so they are broadcast; the others are
    shuffled. The column is dropped.
    """
    side = settle(side, "side")
    heavy = F.col(weight) * 1000 > (side.agg(F.sum(weight)).first()[0] or 0)
    hot, cold = side.filter(heavy).drop(weight), side.filter(~heavy).drop(weight)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column; null is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose id is not among `ids` (`doc_id`); a null id stays.

    The ids are settled, so Spark knows their size: a small table of them is
    broadcast and no text moves, a large one is joined by a shuffle.
    """
    gone = settle(ids.dropna().distinct().withColumnRenamed("doc_id", "_gone_id"), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo `modulus`; a null id gives null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def mix64(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the finaliser of the splitmix generator)."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64, copy=True)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words of ordinary length."""

    LIMIT, LONGEST = 200_000, 48

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def hashed_words(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word of a text, in order."""
    words = text.split()
    return np.fromiter(map(word_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
