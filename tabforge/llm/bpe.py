"""Whole-column encoding with the tokenizers library.

The pre-tokenizers used here never let a token cross a single space between two
visible characters, so a text is cut there first, every *distinct* piece of an
Arrow batch is encoded once by the library, and the ids are laid out again with
NumPy.  Texts with any other white space than single blanks and single line ends
go to the library whole.

They also always cut between a letter and ASCII punctuation other than the apostrophe.  So a
piece of Latin or Cyrillic letters with such marks after them is two pieces, and its letters are
one pre-token: only the library's merge model need see them, in the byte table's characters.
Every other piece takes the library's whole way.
"""

from __future__ import annotations

import base64
import os
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import gather

#: Distinct pieces whose ids a Python worker remembers between batches; beyond that only those of the batch at hand stay.
CACHE_PIECES = 400_000
#: Texts or pieces that go to the library at once; what it returns takes a hundred times the room of the ids.
AT_ONCE = 1024
_ODD_SPACE = "[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Letters in every Unicode version that keep one character in lower case.
_LETTERS = "^[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{24f}\\x{400}-\\x{481}]+$"
_MARKS = string.punctuation.replace("'", "")
#: Most marks that are parted from a word; a longer run stays with it.
_TAIL = 4


def byte_table() -> list[str]:
    """Byte value -> the printable character that byte-level vocabularies write for it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def from_ranks(path: str, pattern: str):
    """A library tokenizer that merges by ranks: every way to put a token together gets the token's rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    ranks, table = read_ranks(path), byte_table()
    shown = {t: "".join(table[b] for b in t) for t in ranks}
    merges = [(shown[t[:i]], shown[t[i:]]) for t, _ in sorted(ranks.items(), key=lambda x: x[1])
              for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tok = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"),
                                                 pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


class ColumnEncoder:
    """Encodes Arrow string columns; ``spaces`` says whether a blank belongs to the word after it
    (if not, the vocabulary is one of lower-case words)."""

    def __init__(self, tokenizer, spaces: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok, self.spaces, self.cache = tokenizer, spaces, {}
        self.tok.encode_special_tokens = True
        self.model = tokenizer.model
        self.shown = [(chr(b), c) for b, c in enumerate(byte_table()) if c != chr(b) and (b == 32 or b > 127)]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for i in range(0, len(texts), AT_ONCE)
                for e in self.tok.encode_batch_fast(texts[i:i + AT_ONCE], add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single pre-tokens."""
        joined = "\n".join(words).encode().decode("latin-1")
        for byte, char in self.shown:
            joined = joined.replace(byte, char)
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in joined.split("\n")] if words else []

    def _pieces(self, pieces: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, start and length of each piece; ``plain`` marks single pre-tokens."""
        found = np.fromiter(map(self.cache.get, pieces), object, len(pieces))
        new = np.equal(found, None).astype(bool)
        for kind, encode in ((plain, self._words), (~plain, self._library)):
            at = np.flatnonzero(new & kind)
            todo = pieces[at].tolist()
            ids = encode(todo)
            self.cache.update(zip(todo, ids, strict=True))
            found[at] = np.fromiter(ids, object, len(ids))
        if len(self.cache) > CACHE_PIECES:
            self.cache = dict(zip(pieces.tolist(), found.tolist(), strict=True))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), np.cumsum(lengths) - lengths, lengths

    def _encode_words(self, words: pa.Array, used: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, start and length of ``words[used]``, where ``lead`` puts a blank before the word."""
        stems = pc.ascii_rtrim(words, characters=_MARKS)
        cut = pc.subtract(pc.binary_length(words), pc.binary_length(stems))
        plain = pc.and_(pc.less_equal(cut, _TAIL), pc.match_substring_regex(stems, _LETTERS))
        heads = pc.if_else(plain, stems if self.spaces else pc.utf8_lower(stems), words).dictionary_encode()
        cut = pc.if_else(plain, cut, 0).to_numpy(zero_copy_only=False)[used]
        # a head with and without the blank are two pieces
        key = 2 * heads.indices.to_numpy(zero_copy_only=False).astype(np.int64)[used] + lead
        marks = np.zeros(2 * len(heads.dictionary), bool)
        marks[key] = True
        seen, of = np.flatnonzero(marks), (np.cumsum(marks) - 1)[key]
        is_plain = np.zeros(len(seen), bool)
        is_plain[of] = plain.to_numpy(zero_copy_only=False)[used]
        blank = pc.if_else(pa.array(seen & 1 == 1), " ", "")
        lists = [pc.binary_join_element_wise(blank, heads.dictionary.take(pa.array(seen >> 1)), ""), pa.array([""])]
        tail = np.full(len(used), len(seen))  # no tail: the empty piece
        for k in range(1, _TAIL + 1):
            at = np.flatnonzero(cut == k)
            tails = pc.utf8_slice_codeunits(words.take(pa.array(used[at])), -k).dictionary_encode()
            tail[at] = tails.indices.to_numpy(zero_copy_only=False) + sum(map(len, lists))
            lists.append(tails.dictionary)
        pieces = np.concatenate([x.to_numpy(zero_copy_only=False) for x in lists])
        ids, starts, lengths = self._pieces(pieces, np.concatenate([is_plain, np.zeros(len(pieces) - len(seen), bool)]))
        parts = np.column_stack([of, tail]).ravel()
        totals = lengths[parts].reshape(-1, 2).sum(axis=1)
        return ids[gather(starts[parts], lengths[parts])], np.cumsum(totals) - totals, totals

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids as uint32, row offsets); null is the empty text."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        line, none = (pc.index(words, pa.scalar(x, words.type)).as_py() for x in ("\n", ""))
        lead = np.ones(len(code), bool)
        lead[offsets[:-1][np.diff(offsets) > 0]] = False
        lead[1:] &= code[:-1] != line
        lead &= code != line
        if self.spaces:
            blanks = np.concatenate([[0], np.cumsum(code == none)])
            empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
            odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
            whole = (odd | (blanks[offsets[1:]] > blanks[offsets[:-1]])) & ~empty
        else:
            lead[:] = False
            whole = np.zeros(n, bool)
        row = np.repeat(np.arange(n), np.diff(offsets))
        skip = whole[row] | (code == none)
        if not self.spaces:
            skip |= code == line
        key = (2 * code + lead)[~skip]
        seen = np.zeros(2 * len(words), bool)
        seen[key] = True
        used, at = np.flatnonzero(seen), (np.cumsum(seen) - 1)[key]
        flat_ids, starts, lengths = self._encode_words(words, used >> 1, used & 1)
        ids = flat_ids[gather(starts[at], lengths[at])] if len(at) else np.zeros(0, np.uint32)
        counts = np.bincount(row[~skip], weights=lengths[at], minlength=n).astype(np.int64) if len(at) else np.zeros(n, np.int64)
        if whole.any():
            odd_rows = np.flatnonzero(whole)
            own = self._library(texts.take(pa.array(odd_rows)).to_pylist())
            ends = np.cumsum(counts)
            parts, last = [], 0
            for r, ids_r in zip(odd_rows.tolist(), own, strict=True):
                parts += [ids[last:ends[r]], np.frombuffer(ids_r, np.uint32)]
                last = ends[r]
                counts[r] = len(ids_r) // 4
            ids = np.concatenate([*parts, ids[last:]])
        return ids, np.concatenate([[0], np.cumsum(counts)])


_MADE: dict[tuple, ColumnEncoder] = {}


def encoder(path: str, spaces: bool = True, pattern: str | None = None) -> ColumnEncoder:
    """One encoder per Python worker and vocabulary file; with ``pattern`` the file holds ranks."""
    if (path, pattern) not in _MADE:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        _MADE[path, pattern] = ColumnEncoder(from_ranks(path, pattern) if pattern else Tokenizer.from_file(path), spaces)
    return _MADE[path, pattern]
