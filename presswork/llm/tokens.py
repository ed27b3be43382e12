"""Token ids of whole texts by a public tokenizer, with the ids of words that come again kept in the worker."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
END = 2
#: Bytes of text encoded at a time.
TOKEN_SLICE = 2 << 20
#: Words kept in a worker (about 300 bytes each) unless a caller says otherwise, and the longest of them in characters.
KEPT_WORDS, KEPT_CHARS = 400_000, 32


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of many runs, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


#: The byte-level alphabet of both vocabularies: printable bytes stand for themselves, the others follow from 256.
_PRINTABLE = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
_ALPHABET = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
#: Blanks as the vocabularies' patterns take them.
_BLANK = r"[\x09-\x0D\x20\x{85}\p{Z}]"
_CUT = "\0"
#: The one letter whose lower case ends in a mark, which the word vocabulary joins to a stop behind it; and the begin of the
#: vocabularies' special tokens, which only stand as they are written and not in capitals.
_GROWING = r"\x{130}[.,;:!?]|<\|"
#: The word vocabulary's pattern, over lower-case characters of one byte.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xAA\xB5\xBA\xDF-\xF6\xF8-\xFF]+|[0-9\xB2\xB3\xB9\xBC-\xBE]|[^\sa-z0-9\xAA\xB2\xB3\xB5\xB9\xBA\xBC-\xBE\xDF-\xF6\xF8-\xFF]+")


class WordTokens:
    """Encodes texts by pieces; ids are little-endian unsigned 32-bit integers.

    Both vocabularies split a text before merging: never across a space but for one that leads a word, and always
    between a letter and a stop, so the ids of a text are those of such pieces in turn. A text in which blanks follow
    each other, which the byte-level vocabulary splits by what comes after, is encoded whole. Words are kept in two
    generations: those that the newer one has not met again when it is full are forgotten with the older one.
    """

    def __init__(self, path: str, leading: bool, kept: int = KEPT_WORDS):
        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.leading = leading
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, piece: str) -> bytes | None:
        """Ids of one word of Latin letters, which no pattern splits, or of its parts; None for other pieces."""
        word = piece[1:] if piece[:1] == " " else piece
        if not word.isalpha():
            return None if self.leading else self._parts(piece)
        if piece.isascii():
            spelled = (_ALPHABET[32] + word if word is not piece else word) if self.leading else word
        elif max(word) > "\xff":
            return None
        else:
            spelled = (piece if self.leading else word.lower()).encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _parts(self, piece: str) -> bytes | None:
        """Ids of a piece that the word vocabulary's pattern splits; None for those with other letters, blanks or controls."""
        if not piece or max(piece) > "\xff" or not piece.isprintable():
            return None
        tokenize, ids = self.tokenizer.model.tokenize, array("I")
        for part in _PARTS.findall(piece.lower()):
            ids.extend([t.id for t in tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_ALPHABET))])
        return ids.tobytes()

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        newer, older, word = self.newer, self.older, self._word
        found = list(map(newer.get, pieces))
        rest = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            piece = pieces[i]
            ids = older.get(piece) or word(piece)
            if ids is None:
                rest.append(i)
            else:
                found[i] = ids
                if len(piece) <= KEPT_CHARS:
                    newer[piece] = ids
        for i, ids in zip(rest, self.encode([pieces[i] for i in rest])):
            found[i] = ids
            if len(pieces[i]) <= KEPT_CHARS:
                newer[pieces[i]] = ids
        if 2 * len(newer) > self.kept:
            self.newer, self.older = {}, newer
        return found

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each text's followed by ``end``; and the number of each text's."""
        odd = pc.or_(pc.match_substring(texts, _CUT), pc.match_substring_regex(texts, (_BLANK + "{2}") if self.leading else _GROWING))
        cut = pc.if_else(odd, "", texts)
        if self.leading:
            cut = pc.replace_substring(pc.replace_substring(cut, "\n", f"{_CUT}\n{_CUT}"), " ", f"{_CUT} ")
        else:
            cut = pc.replace_substring(pc.replace_substring(pc.ascii_lower(cut), "\n", _CUT), " ", _CUT)
        cut = pc.replace_substring_regex(cut, r"(\p{L})([.,;:!?])", f"\\1{_CUT}\\2")
        lists = pc.split_pattern(cut, _CUT)
        coded, offsets = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        ids = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = coded.indices.to_numpy(zero_copy_only=False).copy()
        codes[offsets[whole]] = len(ids) + np.arange(len(whole))
        ids += self.encode(texts.take(pa.array(whole)).to_pylist())
        codes = np.insert(codes, offsets[1:], len(ids))
        ids.append(np.array([end], "<u4").tobytes())
        made = pa.array(ids, pa.large_binary()).take(pa.array(codes))
        edges, flat = np.frombuffer(made.buffers()[1], np.int64, len(codes) + 1) // 4, np.frombuffer(made.buffers()[2], "<u4")
        return flat[: edges[-1]], np.diff(edges[np.append(0, offsets[1:] + np.arange(1, len(texts) + 1))])


@lru_cache(maxsize=2)
def word_tokens(name: str, kept: int = KEPT_WORDS) -> WordTokens:
    """One encoder for each worker process. ``name``: a file of the public vocabularies, or a path to one like it."""
    return WordTokens(name if "/" in name else public_tokenizers.path(name), leading=not name.endswith(WORD_BPE), kept=kept)


def with_end(texts: pa.Array, name: str, end: int = END, kept: int = KEPT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, the end id after each text's; and the number of each text's."""
    return word_tokens(name, kept)(texts, end) if len(texts) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Bytes of consecutive runs of values."""
    edges = np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
