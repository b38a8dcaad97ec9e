"""Token counts: linear longest-match word pieces that are counted without being built.

The vocabulary is a trie. Every node holds a failure link and the number of tokens that are popped when the link is
taken: the greedy longest-match pieces of the node's text that come before the link's text. A word is read once,
left to right; each character either goes down the trie or pops, so the work is linear in the word's length however
long the pieces are.

A word starts with the marker, as the pieces that begin words do. A character that no piece starts with or is left
over counts as the bytes of its UTF-8 form.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from evenkeel.llm.common import append_columns

MARKER = "▁"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: How many distinct words a Python worker remembers; further ones are read again each time.
COUNTS_KEPT = 300_000


def sentencepiece_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model without control and byte pieces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Automaton:
    """Trie nodes by number: ``down`` (children), ``fail`` (link), ``popped`` (tokens of the link), ``rest`` (tokens of the whole text)."""

    def __init__(self, pieces: Iterable[str]):
        self.down: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                to = self.down[at].get(c)
                if to is None:
                    to = self.down[at][c] = len(self.down)
                    self.down.append({})
                    ends.append(False)
                at = to
            ends[at] = ends[at] or at > 0
        size = len(self.down)
        self.fail, self.popped, self.rest = [0] * size, [0] * size, [0] * size
        layer = [(0, c, to) for c, to in self.down[0].items()]
        while layer:
            for at, c, node in layer:
                if ends[node]:
                    self.popped[node], self.fail[node] = 1, 0
                elif at == 0:
                    self.popped[node], self.fail[node] = len(c.encode("utf-8", "surrogatepass")), 0
                else:
                    self.popped[node], self.fail[node] = self._read(self.fail[at], c, self.popped[at])
                self.rest[node] = self.popped[node] + self.rest[self.fail[node]]
            layer = [(node, c, to) for _, _, node in layer for c, to in self.down[node].items()]

    def _read(self, at: int, c: str, count: int) -> tuple[int, int]:
        """Count and node after reading ``c`` at node ``at``."""
        while c not in self.down[at]:
            if at == 0:
                return count + len(c.encode("utf-8", "surrogatepass")), 0
            count, at = count + self.popped[at], self.fail[at]
        return count, self.down[at][c]

    def count(self, text: str) -> int:
        """Number of greedy longest-match pieces of ``text``."""
        down, fail, popped = self.down, self.fail, self.popped
        at, count = 0, 0
        for c in text:
            to = down[at].get(c)
            while to is None:
                if at == 0:
                    count += len(c.encode("utf-8", "surrogatepass"))
                    to = 0
                else:
                    count += popped[at]
                    at = fail[at]
                    to = down[at].get(c)
            at = to
        return count + self.rest[at]


class _Counts(dict):
    def __init__(self, automaton: Automaton, marker: str):
        super().__init__()
        self.automaton, self.marker = automaton, marker

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(self.marker + word)
        if len(self) < COUNTS_KEPT:
            self[word] = n
        return n


def token_counts(docs: DataFrame, pieces: list[str], text_col: str = "text", marker: str = MARKER) -> DataFrame:
    """Add ``n_words`` and ``n_tokens``, the greedy longest-match pieces of all words (parted by ASCII white space).

    All rows and columns stay; a column that has the name of an output is replaced. Null, empty and blank
    texts have 0 of both. The vocabulary (bounded by its file) is sent to every task, which builds the automaton once.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pieces, marker))
    fields = StructType([StructField("n_words", LongType()), StructField("n_tokens", LongType())])

    def make():
        counts = _Counts(Automaton(shared.value[0]), shared.value[1])

        def work(texts: list) -> list:
            n_words, n_tokens = [], []
            for text in texts:
                found = WORD.findall(text) if text else []
                n_words.append(len(found))
                n_tokens.append(sum(map(counts.__getitem__, found)))
            return [n_words, n_tokens]
        return work

    return append_columns(docs, [text_col], fields, make)
