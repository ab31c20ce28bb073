"""SentencePiece BPE by a prefix table, encoding and decoding.

The library merges, again and again, the two neighbours whose joined piece has the best score, the leftmost of equals. This encodes
to the same ids without merging the text:

* The encoding of every prefix of a text ends in one token, and the tokens before it are the encoding of the prefix without it. A
  sequence is an encoding exactly if each two neighbours, merged alone, stay as they are: merges within a span never look outside
  it, so the first merge over a border of two tokens would also come first if those two stood alone.
* So an automaton lists the pieces that end at each character, and the one whose pair with the last token before it is compatible
  is the prefix's last token. A pair's test follows the merges within both in their order and asks whether one over their border
  would come between; its answer is remembered.
* The ids are read backwards from the end of the table. A character without a piece is its bytes.

Where no piece of the model crosses the start of a run of word marks, the words of a text are encoded apart, and short words are
remembered. The table has one integer for each character of a word, so a task needs memory in proportion to one text, and time in
proportion to its length.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; an empty table gives an empty
result; rows stay as they are, repeated ones and null ids too. Only doc_id and text are read. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows, whole_text

#: Fixed value: the sign that stands for a blank.
MARK = "▁"
NOTHING, NEVER = -(1 << 21), float("inf")


class PieceBpe:
    WORD_CHARS, WORDS, PAIRS, LONG = 48, 3 << 17, 1 << 20, 1 << 16

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        self.core = core = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(core.get_piece_size())
        bytes_of = {core.id_to_piece(i): i for i in ids if core.is_byte(i)}
        if len(bytes_of) != 256:
            raise ValueError(f"{model_path} has no pieces for bytes")
        self.byte_ids = [bytes_of[f"<0x{b:02X}>"] for b in range(256)]
        self.piece = {i: core.id_to_piece(i) for i in ids if not (core.is_byte(i) or core.is_control(i) or core.is_unknown(i) or core.is_unused(i))}
        self.length = {i: len(p) for i, p in self.piece.items()}
        self.own = {i: i for i in self.piece}  # one object for each id, so that remembered words are small
        self.score = {p: core.get_score(i) for i, p in self.piece.items()}
        self.id_of = {p: i for i, p in self.piece.items()}
        self.automaton = ahocorasick.Automaton()
        for i, p in self.piece.items():
            self.automaton.add_word(p, (i, len(p), i * core.get_piece_size()))
        self.automaton.make_automaton()
        apart = not any(MARK in p.lstrip(MARK) for p in self.score)
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if apart else r"[\s\S]+").findall
        self.size = core.get_piece_size()
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.orders: dict[int, tuple[list[str], list[str], list[float]] | None] = {}

    # encoding
    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for word in self.words(self.core.normalize(text)):
            ids = known.get(word)
            if ids is None:
                ids = self.remembered(word)
                known = self.known
            out += ids
        return out

    def remembered(self, word: str) -> list[int]:
        """The ids of a word that isn't among the latest; of two generations of words the older goes when the newer is full."""
        ids = self.older.get(word)
        if ids is None:
            ids = self.word(word)
        if len(word) <= self.WORD_CHARS:
            if len(self.known) >= self.WORDS:
                self.known, self.older = {}, self.known
            self.known[word] = ids
        return ids

    def last_tokens(self, word: str) -> list[int]:
        """For each character, the token that ends the encoding of the word up to it; ~code where a character has no piece."""
        return [x // self.size for x in self._table(word)[1:]]

    def _table(self, word: str) -> list[int] | array:
        """NOTHING, then the last token after each character, all times the number of pieces: so a pair's key is one sum."""
        size, pairs, done = self.size, self.pairs, -1
        last = [NOTHING * size, *(~ord(c) * size for c in word)]
        if len(word) > self.LONG:
            last = array("q", last)
        for end, (token, n, scaled) in self.automaton.iter(word):  # ends ascend
            if end != done:
                before = last[end + 1 - n]
                fits = pairs.get(before + token)
                if fits is None:
                    fits = self.compatible(before // size, token)
                if fits:
                    last[end + 1], done = scaled, end
        return last

    def word(self, word: str) -> list[int]:
        last, at, out, size = self._table(word), len(word), [], self.size
        while at:
            token = last[at] // size
            if token < 0:
                out += [self.byte_ids[b] for b in reversed(word[at - 1].encode())]
                at -= 1
            else:
                out.append(self.own[token])
                at -= self.length[token]
        out.reverse()
        return out

    def compatible(self, before: int, token: int) -> bool:
        """Whether both stay as they are when their characters are merged alone; with NOTHING before, whether the token does.

        The merges within each of the two come in their own order. The pair falls apart if the two symbols at the border have a
        joined piece whose turn comes: before the next merge within either, a tie going to the left one.
        """
        key = before * self.size + token
        if len(self.pairs) >= self.PAIRS:
            self.pairs.clear()
        self.pairs[key] = fits = self._fits(before, token)
        return fits

    def _fits(self, before: int, token: int) -> bool:
        right = self.order(token)
        if before == NOTHING:
            return right is not None
        left = self.order(before)
        if left is None or right is None:
            return False
        (left_ends, left_turns), (right_starts, right_turns) = (left[1], left[2]), (right[0], right[2])
        i = j = 0
        while True:
            turn_i, turn_j = left_turns[i], right_turns[j]
            score = self.score.get(left_ends[i] + right_starts[j])
            if score is not None and -score < turn_i and -score <= turn_j:
                return False
            if turn_i == turn_j == NEVER:
                return True
            if turn_i <= turn_j:
                i += 1
            else:
                j += 1

    def order(self, token: int) -> tuple[list[str], list[str], list[float]] | None:
        """Of the merges that make a token of its characters, one after the other: its first and its last symbol before each, and the turn (negative score) of each; None if they don't end in the token."""
        if token not in self.orders:
            parts = [chr(~token)] if token < 0 else list(self.piece[token])
            starts, ends, turns = [parts[0]], [parts[-1]], []
            while joined := [(-self.score[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score]:
                turn, i = min(joined)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                turns.append(turn)
                starts.append(parts[0])
                ends.append(parts[-1])
            if token < 0 and len(self.orders) > 2 * self.size:  # characters without a piece
                self.orders.clear()
            self.orders[token] = (starts, ends, [*turns, NEVER]) if len(parts) == 1 else None
        return self.orders[token]

    def merged(self, chars: str) -> list[str]:
        """The library's rule, character by character: what the tests compare with."""
        parts = list(chars)
        while joined := [(-self.score[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score]:
            _, i = min(joined)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    # decoding
    def decode(self, ids: list[int]) -> str:
        return self.core.decode(ids) if ids else ""


_known: dict[str, PieceBpe] = {}


def piece_bpe(model_path: str) -> PieceBpe:
    """One for each worker process."""
    if model_path not in _known:
        _known[model_path] = PieceBpe(model_path)
    return _known[model_path]


def _mapped(df: DataFrame, model_path: str, schema: str, columns: Callable[[PieceBpe, list], list[tuple[list, pa.DataType]]]) -> DataFrame:
    """doc_id and further columns made from the second one, batch by batch; no shuffle."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(model_path)
        for batch in text_rows(batches):
            made = columns(bpe, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values, kind) for values, kind in made)], names)

    return df.mapInArrow(run, schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    return _mapped(_texts(docs, id_col, text_col), model_path, "doc_id long, ids array<int>", lambda bpe, texts: [([bpe.encode(t) for t in texts], pa.list_(pa.int32()))])


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); null ids give the empty text."""
    return _mapped(encoded.select(F.col("doc_id").cast("long"), "ids"), model_path, "doc_id long, text string", lambda bpe, rows: [([bpe.decode(ids or []) for ids in rows], pa.string())])


def round_trip_digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, so that ids need not leave the task."""

    def digests(bpe: PieceBpe, texts: list[str]) -> list[tuple[list, pa.DataType]]:
        n, ids_sha, text_sha = [], [], []
        for text in texts:
            ids = bpe.encode(text)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return [(n, pa.int64()), (ids_sha, pa.string()), (text_sha, pa.string())]

    return _mapped(_texts(docs, id_col, text_col), model_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
