"""Encoding with a public tokenizer: the distinct pieces of a slice are encoded once, frequent ones are remembered.

The byte-level pre-tokenizer always starts anew at a space that visible text follows, at a line end between visible
text, and at a mark behind a letter, so texts can be cut there and their pieces encoded apart.  Arrow cuts a slice of
texts and numbers its distinct pieces; Python sees each distinct piece once a slice, and the library only those that
are not remembered.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import memory, slices

CUT = re.compile(r"(?= \S)")
SEPARATOR = "\x01"
LETTER_MARK = "([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([.,;:!?|])"
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies use: visible bytes stand for themselves, others for 256 and up."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = _byte_letters()
SPACE = LETTERS[ord(" ")]


class PieceEncoder:
    """Encodes texts to integers of `dtype` (16 bits where all ids fit) by way of their pieces.

    At most about `limit` pieces are remembered, as Arrow strings beside their ids; the least recently used half goes
    when there are more.  A piece of letters is one word and goes straight to the model.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.turn = Tokenizer.from_file(path), limit, 0
        self.word = self.tokenizer.model.tokenize
        self.uncut = [SEPARATOR, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]  # texts with these are cut at spaces only
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = pa.array([], pa.string())
        self.ids, self.sizes = np.zeros(0, self.dtype), np.zeros(0, np.int64)
        self.blank, self.used = np.zeros(0, bool), np.zeros(0, np.int32)  # is white space at an end?  when last asked for?

    def _made(self, piece: str) -> list[int]:
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            if piece.isascii():
                letters = SPACE + piece[1:] if piece[0] == " " else piece
            else:
                letters = piece.encode().decode("latin-1").translate(LETTERS)
            return [t.id for t in self.word(letters)]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _forget(self) -> None:
        keep = np.flatnonzero(self.used > np.median(self.used))
        if len(keep) > self.limit // 2:
            keep = keep[-self.limit // 2 :]
        self.ids = self._lists().take(pa.array(keep)).flatten().to_numpy()
        self.known, self.sizes, self.blank, self.used = self.known.take(pa.array(keep)), self.sizes[keep], self.blank[keep], self.used[keep]

    def _lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.sizes)]), pa.int32()), pa.array(self.ids))

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where each of the distinct pieces stands among the known ones, which now hold all of them."""
        self.turn += 1
        if len(self.known) > self.limit:
            self._forget()
        place = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.known) + np.arange(len(new))
            strings = distinct.take(pa.array(new))
            pieces = strings.to_pylist()
            made = [self._made(x) if x else [] for x in pieces]
            blank = [x != "\n" and x != "" and (x[-1].isspace() or x[0] != " " and x[0].isspace() or x[1:2].isspace()) for x in pieces]
            self.known = pa.concat_arrays([self.known, strings])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(made), self.dtype)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, made), np.int64, len(made))])
            self.blank, self.used = np.concatenate([self.blank, np.array(blank, bool)]), np.concatenate([self.used, np.zeros(len(new), np.int32)])
        self.used[place] = self.turn
        return place

    def _encoded(self, pieces: pa.Array, first: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, pa.Array]:
        """Counts per text (which begins at the piece `first`), ids, places of the pieces, and the dictionary."""
        known = pieces.dictionary_encode()
        place = self._places(known.dictionary)[known.indices.to_numpy()]
        counts = np.add.reduceat(self.sizes[place], first) if len(first) else np.zeros(0, np.int64)
        return counts, self._lists().take(pa.array(place)).flatten().to_numpy() if ids else None, place, known

    def encode_slice(self, texts: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """How many ids each text has, and (if asked for) all ids one after another."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        cut = pc.replace_substring(pc.replace_substring(texts, " ", f"{SEPARATOR} "), "\n", f"{SEPARATOR}\n{SEPARATOR}")
        cut = pc.replace_substring_regex(cut, LETTER_MARK, f"\\1{SEPARATOR}\\2")
        parts = pc.split_pattern(cut, SEPARATOR)
        first = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        counts, flat, place, known = self._encoded(parts.flatten(), first, ids)
        # Runs of white space are cut otherwise: texts with one are cut at spaces before visible text only.
        run = self.blank[place]
        end, none = (known.indices.to_numpy() == known.dictionary.index(x).as_py() for x in ("\n", ""))
        run[:-2] |= end[:-2] & none[1:-1] & end[2:]
        whole = np.logical_or.reduce([pc.match_substring(texts, x).to_numpy(zero_copy_only=False) for x in self.uncut])
        odd = np.flatnonzero((np.add.reduceat(run, first, dtype=np.int64) > 0) | whole) if len(first) else first
        if len(odd):
            lists = [CUT.split(x) for x in texts.take(pa.array(odd)).to_pylist()]
            begin = np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]])
            again, other, _, _ = self._encoded(pa.array(list(itertools.chain.from_iterable(lists)), pa.string()), begin, ids)
            if ids:
                runs = np.split(flat, np.cumsum(counts)[:-1])
                for i, x in zip(odd.tolist(), np.split(other, np.cumsum(again)[:-1])):
                    runs[i] = x
                flat = np.concatenate(runs)
            counts[odd] = again
        return counts, flat

    def encode_all(self, texts: pa.Array, ids: bool = True, most: int = 8 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(first row, counts, ids) of slices of texts, so that memory follows the longest text and not the batch."""
        for a, b in slices(texts, most):
            yield a, *self.encode_slice(texts[a:b], ids)


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker, which tasks of a stage share."""
    return memory(("tokens", path), functools.partial(PieceEncoder, path))
