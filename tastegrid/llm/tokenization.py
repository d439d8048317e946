"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is split into pieces by the vocabulary's pattern. Within a piece, the tokens of the encoding of each prefix
are the tokens of a shorter prefix and one last token, and that last token is unique: of the vocabulary's tokens
that end at the prefix, found by an automaton with suffix links, it is the one that the encoding of the rest can
stand beside unmerged. The last token of every prefix is stored; following these pointers back from the end gives
the ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.runtime import sliced, spread

# Where byte-level BPE splits a text into pieces before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Pieces whose ids a Python worker remembers; then it forgets them all. This bounds memory, not results.
REMEMBERED_PIECES = 200_000
#: Longer pieces are encoded anew each time.
REMEMBERED_LENGTH = 64

_NEVER = 1 << 60


def _byte_alphabet() -> dict[str, int]:
    """The printable characters by which vocabulary files write the 256 bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


class BytePairEncoder:
    """Exact BPE ids by dynamic programming over prefixes."""

    def __init__(self, vocabulary: str) -> None:
        """``vocabulary``: the text of a tokenizer JSON file with a byte-level BPE model."""
        model = json.loads(vocabulary)["model"]
        alphabet = _byte_alphabet()
        latin = {name: "".join(chr(alphabet[c]) for c in name) for name in model["vocab"] if all(c in alphabet for c in name)}
        ids = {latin[name]: i for name, i in model["vocab"].items() if name in latin}
        self._merge_rank: dict[tuple[int, int], int] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._made_at: dict[int, int] = {}
        reachable = {ids[chr(b)] for b in range(256)}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = ids[latin[a]], ids[latin[b]], ids[latin[a] + latin[b]]
            self._merge_rank[left, right] = rank
            if whole not in self._halves:
                self._halves[whole], self._made_at[whole] = (left, right), rank
                reachable.add(whole)
        self._automaton = ahocorasick.Automaton()
        for word, i in ids.items():
            if i in reachable:
                self._automaton.add_word(word, (len(word), i))
        self._automaton.make_automaton()
        self._pattern = regex.compile(SPLIT_PATTERN)
        self._compatible: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and its parts along one edge, each with the rank of the merge that used it up."""
        spine, until = [(token, _NEVER)], _NEVER
        while token in self._halves:
            until = self._made_at[token]
            token = self._halves[token][side]
            spine.append((token, until))
        return spine

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stand beside each other in the encoding of their joined bytes.

        They don't if two parts along the common edge merge while both are there. Merges of equal rank go from
        left to right: one inside the left token comes before one across the edge, one inside the right token after.
        """
        pair = left, right
        if pair not in self._compatible:
            ranks, inner = self._merge_rank, self._spine(right, 0)
            if len(self._compatible) > 2_000_000:
                self._compatible.clear()
            self._compatible[pair] = not any(
                (rank := ranks.get((a, b), _NEVER)) < a_until and rank <= b_until and rank < _NEVER
                for a, a_until in self._spine(left, 1)
                for b, b_until in inner
            )
        return self._compatible[pair]

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece."""
        data = piece.encode("utf-8").decode("latin-1")
        last: list[tuple[int, int] | None] = [None] * (len(data) + 1)  # of each prefix: the last token and its length
        for end, (length, token) in self._automaton.iter(data):
            end += 1
            if last[end] is None:
                start = end - length
                before = last[start]
                if start == 0 or (before is not None and self.compatible(before[0], token)):
                    last[end] = token, length
        ids, at = [], len(data)
        while at:
            token, length = last[at]
            ids.append(token)
            at -= length
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without special tokens; an empty list for an empty text."""
        pieces, ids = self._pieces, []
        for piece in self._pattern.findall(text):
            known = pieces.get(piece)
            if known is None:
                known = self.encode_piece(piece)
                if len(piece) <= REMEMBERED_LENGTH:
                    if len(pieces) >= REMEMBERED_PIECES:
                        pieces.clear()
                    pieces[piece] = known
            ids += known
        return ids


_ENCODERS: dict[int, BytePairEncoder] = {}


def _encoder(vocabulary: str) -> BytePairEncoder:
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(vocabulary)
    return _ENCODERS[key]


def encode_corpus(
    documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, ids ARRAY<INT>: each row's whole text encoded without special tokens.

    An empty and a null text have an empty list. Rows, repeated ones too, are encoded one by one, without a shuffle
    of a large input; further columns are ignored. ``vocabulary`` is a file on the driver; its content, of a fixed
    size, is broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in sliced(batches):
            offsets, ids = [0], []
            for text in batch.column(1).to_pylist():
                if text:
                    ids += encoder.encode(text)
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "ids"])

    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return spread(rows).mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)
