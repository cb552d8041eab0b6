"""Token counts: greedy longest-match word pieces counted in one pass over the characters.

A trie of the vocabulary has, at each node, a failure link and the number of pieces that
following the link closes ("popped"). Reading a word, every character either extends the
match or pops pieces through a link, so a word costs time linear in its length and no
piece is ever built. Words are the maximal runs of non-white characters; ``▁`` is put
before each, so that pieces with ``▁`` start words and the others go on with them. A
character that no piece matches costs its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: Placed before each word.
WORD_START = "▁"
#: Words whose counts a worker remembers; beyond it, it starts anew. Bounds memory, not results.
CACHED_WORDS = 1 << 18
COUNTS = "doc_id long, n_words long, n_chars long, n_tokens long"


class Automaton:
    """Longest-match automaton over a vocabulary.

    ``children[v]``: character to node. ``fail[v]``: the node to go on from once the tokens
    that node v's string greedily closes are popped; ``popped[v]``: how many tokens those
    are. A character without a piece is closed by its bytes, so every node has a link.
    """

    def __init__(self, pieces: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        whole, parent, char = [False], [0], [""]
        for piece in pieces:
            at = 0
            for c in piece:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    whole.append(False)
                    parent.append(at)
                    char.append(c)
                at = nxt
            whole[at] = True
        n = len(self.children)
        self.fail, self.popped = [0] * n, [0] * n
        queue = deque(self.children[0].values())
        while queue:
            v = queue.popleft()
            queue.extend(self.children[v].values())
            if whole[v]:
                self.popped[v] = 1
            elif parent[v] == 0:
                self.popped[v] = n_bytes(char[v])
            else:
                # The parent's tokens are closed first; what is left of its string is followed until it takes this character.
                at, n_popped = self.fail[parent[v]], self.popped[parent[v]]
                while at and char[v] not in self.children[at]:
                    n_popped += self.popped[at]
                    at = self.fail[at]
                self.fail[v] = self.children[at].get(char[v], 0)
                self.popped[v] = n_popped + (0 if self.fail[v] else n_bytes(char[v]))

    def count(self, word: str) -> int:
        """Tokens of greedy longest match over ``▁word``; an unmatched character counts its UTF-8 bytes."""
        children, fail, popped = self.children, self.fail, self.popped
        total = at = 0
        for c in WORD_START + word:
            while at and c not in children[at]:
                total += popped[at]
                at = fail[at]
            at = children[at].get(c, 0)
            if not at:
                total += n_bytes(c)
        while at:
            total += popped[at]
            at = fail[at]
        return total


def n_bytes(c: str) -> int:
    return len(c.encode("utf-8", "surrogatepass"))


def load_pieces(model_file: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file (no control, unknown, byte or unused pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def token_counts(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """Per document: words, characters and greedy word-piece tokens of its whole text.

    A null text counts as empty (all zero); a null doc_id stays null; repeated rows stay
    repeated; other columns are ignored. Each row is counted alone, so there is no shuffle.
    ``pieces`` is the vocabulary, of fixed size, sent to the workers once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(pieces)
        count, known = automaton.count, {}
        for batch in batches:
            words_of, tokens_of, chars_of = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                total = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        n = count(word)
                        if len(word) <= 64:
                            if len(known) >= CACHED_WORDS:
                                known.clear()
                            known[word] = n
                    total += n
                words_of.append(len(words))
                tokens_of.append(total)
                chars_of.append(len(text or ""))
            columns = [pa.array(x, pa.int64()) for x in (words_of, chars_of, tokens_of)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_chars", "n_tokens"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, COUNTS)
