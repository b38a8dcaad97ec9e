"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``size`` consecutive words of an item; a shorter item with words is one window. A document word is hit
if it lies in an occurrence of a window. The join asks for whole windows (containment 1), so the necessary prefix of
a window, its words ordered by rarity in the documents, is its rarest word alone: a document without that word
cannot hold the window. Each place of that word gives one candidate; the word's place in the window fixes where the
window would start (positional bound), it must lie inside the document (length bound), and the words are then
compared one by one over the window.

The items are a query set: they are read in blocks of at most ``block_chars`` characters, each block is sent to every
task and meets every document where it lies. Documents are never shuffled, and a passage that fills half the corpus
costs each task no more than its own occurrences.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from evenkeel.llm.common import append_columns, utf8
from evenkeel.session import materialize

WINDOW = 10
BLOCK_CHARS = 32_000_000

# ASCII letters in lower case and digits belong to words, every other ASCII byte parts them.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; none for null."""
    return utf8(text).translate(_TO_WORDS).split()


def windows(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items as (id as text, text), read one partition at a time, in blocks of bounded size."""
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    block, size = [], 0
    for name, text in rows.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += len(text)
    if block:
        yield block


def word_counts(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> Counter:
    """How often each word of the vocabulary (one block's) occurs in all documents; counted per task first."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = shared.value.__contains__, Counter()
        for batch in batches:
            for text in batch[text_col]:
                seen.update(filter(known, words(text)))
        yield pd.DataFrame({"w": list(seen.keys()), "n": list(seen.values())})

    rows = docs.select(text_col).where(F.col(text_col).isNotNull()).mapInPandas(count, "w binary, n bigint")
    return Counter({bytes(w): n for w, n in rows.groupBy("w").agg(F.sum("n")).collect()})


class Index:
    """Windows of one block by their prefix: the rarest word, with its place in the window."""

    def __init__(self, block: list[tuple[str, str]], size: int, counts: Counter):
        self.items: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
        for name, text in block:
            for w in windows(text, size):
                self.items[w].append(name)
        self.by_prefix: dict[bytes, list[tuple[int, tuple[bytes, ...]]]] = defaultdict(list)
        for w in self.items:
            place = min(range(len(w)), key=lambda i: (counts[w[i]], w[i], i))
            self.by_prefix[w[place]].append((place, w))

    def search(self, doc: list[bytes]) -> tuple[list[int], set[str]]:
        """Numbers of the words hit, ascending, and the ids of the items found."""
        found, marks = set(), None
        for at in [i for i, word in enumerate(doc) if word in self.by_prefix]:
            for place, window in self.by_prefix[doc[at]]:
                start = at - place
                if start >= 0 and start + len(window) <= len(doc) and tuple(doc[start:start + len(window)]) == window:
                    if marks is None:
                        marks = np.zeros(len(doc), bool)
                    marks[start:start + len(window)] = True
                    found.update(self.items[window])
        return ([] if marks is None else np.flatnonzero(marks).tolist()), found


def hits(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text_col: str = "text",
         size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add to each document ``n_words``, ``hit_words`` (numbers of the words hit, from 0) and ``item_ids`` (as strings, sorted).

    All rows and columns stay, repeated rows too; a column that has the name of an output is replaced. Null and
    wordless texts have no words and are never hit. Items without id or words match nothing; items that repeat an
    id count once; of items with equal windows all are named. Without items no word is hit.
    """
    spark: SparkSession = docs.sparkSession
    fields = StructType([StructField("n_words", LongType()), StructField("hit_words", ArrayType(IntegerType(), False)),
                         StructField("item_ids", ArrayType(StringType(), False))])
    done: DataFrame | None = None
    for block in item_blocks(items, item_id, item_text, block_chars):
        vocabulary = {w for _, text in block for w in words(text)}
        index = spark.sparkContext.broadcast(Index(block, size, word_counts(docs, text_col, vocabulary)))
        done = _pass(docs, index, text_col, fields) if done is None else materialize(
            _merged(_pass(done.withColumnsRenamed({c: f"_{c}" for c in fields.names}), index, text_col, fields), fields))
    return done if done is not None else _pass(docs, spark.sparkContext.broadcast(Index([], size, Counter())), text_col, fields)


def _pass(docs: DataFrame, index, text_col: str, fields: StructType) -> DataFrame:
    def make():
        search = index.value.search

        def work(texts: list) -> list:
            n, hit, names = [], [], []
            for text in texts:
                doc = words(text)
                places, found = search(doc)
                n.append(len(doc))
                hit.append(places)
                names.append(sorted(found))
            return [n, hit, names]
        return work

    return append_columns(docs, [text_col], fields, make)


def _merged(df: DataFrame, fields: StructType) -> DataFrame:
    old = [f"_{c}" for c in fields.names]
    return df.withColumns({c: F.array_sort(F.array_union(c, f"_{c}")) for c in ("hit_words", "item_ids")}).drop(*old)


def summary(hit: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`hits`, one row per document."""
    return hit.select(
        id_col, "n_words", F.size("hit_words").cast("bigint").alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))
