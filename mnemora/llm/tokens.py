"""Token ids of whole texts, fast: a memo from chunks without white space to their ids.

The tokenizer's pre-tokenizer never joins text across white space and cuts a chunk into pieces by a fixed pattern, so a
text's ids are the ids of its pieces in order. ASCII letters can be lower-cased first, as the tokenizer lower-cases;
test_tokens.py holds this against the library. Chunks that NFC would change go to the tokenizer whole.
"""

from __future__ import annotations

import os
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text that are encoded at once: the more, the fewer chunks are distinct.
RUN_BYTES = 8_000_000
#: The pattern of the tokenizer file's pre-tokenizer (fixed value of that format).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The letters that NFC and lower-casing turn into a letter and a mark (all 60 of Unicode): a sign after one joins the mark's piece.
MARKED = "İ\u0958-\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69\ufb1d\ufb1f\ufb2a-\ufb36\ufb38-\ufb3c\ufb3e\ufb40\ufb41\ufb43\ufb44\ufb46-\ufb4e"
#: Signs after a letter and before white space, which are a piece of their own.
SIGNS = rf"([^\PL{MARKED}])([!-/:-@\[-`{{-~]+)(\s)"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def tokenizer(path: str):  # noqa: ANN201
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@cache
def piece_tokenizer(path: str):  # noqa: ANN201
    """The same model for pieces, which are normalised and cut already: parted by spaces, they are only spelt as bytes and merged."""
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer(tokenizer(path).model)
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
    return t


def lowers_plainly(text: str) -> bool:
    """NFC doesn't change the text, and Python lower-cases its characters as the tokenizer does."""
    from tokenizers.normalizers import Lowercase

    if not is_normalized("NFC", text) or "İ" in text or "Σ" in text:
        return False
    signs = "".join(set(text))
    return Lowercase().normalize_str(signs) == signs.lower()


def vocabulary(path: str) -> int:
    return tokenizer(path).get_vocab_size()


class ChunkIds:
    """Memo: chunk of UTF-8 without ASCII white space, lower-cased, to its ids as little-endian bytes.

    Pieces of chunks are chunks themselves and share the memo. It has two generations: a full one becomes the old one,
    and what is met again moves to the new one, so that frequent chunks are never learnt twice and memory is bounded by
    twice `most` chunks and those of one run of texts. Each task has its own, as workers live on for other work.
    """

    def __init__(self, path: str, end: int, most: int = 200_000) -> None:
        self.tok, self.lean = tokenizer(path), piece_tokenizer(path)
        vocab = self.tok.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocab) <= 1 << 16 else "<u4")
        self.end, self.most = np.array([end], self.dtype).tobytes(), most
        self.new: dict[bytes, bytes] = {}  # plain dicts: sets are held against these without being copied
        self.old: dict[bytes, bytes] = {}
        # each piece ends with one id of a word end, so many pieces can be encoded as one text and be told apart
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _learn_pieces(self, new: list[bytes]) -> None:
        for a in range(0, len(new), 1000):
            some = new[a : a + 1000]
            ids = np.array(self.lean.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int64)
            cut = ((np.flatnonzero(self.closes[ids]) + 1) * self.dtype.itemsize).tolist()
            raw = ids.astype(self.dtype).tobytes()
            if len(cut) == len(some) and (not cut or cut[-1] == len(raw)):
                self.new.update(zip(some, [raw[x:y] for x, y in zip([0, *cut], cut, strict=False)], strict=True))
            else:  # a vocabulary without word ends
                for p, e in zip(some, self.tok.encode_batch_fast([p.decode() for p in some], add_special_tokens=False), strict=True):
                    self.new[p] = np.array(e.ids, self.dtype).tobytes()

    def _unknown(self, chunks: set[bytes]) -> set[bytes]:
        """What neither generation knows; what the old one knows moves to the new one."""
        left = chunks.difference(self.new)
        if self.old:
            again = [c for c in left if c in self.old]
            self.new.update(zip(again, map(self.old.__getitem__, again), strict=True))
            left.difference_update(again)
        return left

    def learn(self, chunks: set[bytes]) -> None:
        rest = [c for c in chunks if not c.isalpha()]
        pieces = chunks.difference(rest)  # ASCII letters alone: one piece
        parts: dict[bytes, list[bytes]] = {}
        text = b" ".join(rest).decode()
        if lowers_plainly(text):
            low = text.lower().split(" ")
        else:
            every = [c.decode() for c in rest]
            odd = [not lowers_plainly(t) for t in every]
            for c, t, o in zip(rest, every, odd, strict=True):
                if o:
                    self.new[c] = np.array(self.tok.encode_batch_fast([t], add_special_tokens=False)[0].ids, self.dtype).tobytes()
            low = [t.lower() for t, o in zip(every, odd, strict=True) if not o]
            rest = [c for c, o in zip(rest, odd, strict=True) if not o]
        for c, t in zip(rest, low, strict=False):  # nothing to part is one empty text
            if t.isalpha():
                ps = [t.encode()]
            elif t[-1:] in ".,!" and t[:-1].isalpha():
                ps = [t[:-1].encode(), t[-1:].encode()]
            else:
                ps = [p.encode() for p in PIECES.findall(t)]
            pieces.update(ps)
            if ps != [c]:
                parts[c] = ps
        self._learn_pieces(list(self._unknown(pieces)))
        ids = self.new
        for c, ps in parts.items():
            ids[c] = ids[ps[0]] + ids[ps[1]] if len(ps) == 2 else b"".join([ids[p] for p in ps])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: empty), each text's followed by the end id, and the count of each text.

        Only distinct chunks meet the memo; words are cut, numbered and replaced by their ids in whole columns.
        """
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        low = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(low, SIGNS, r"\1 \2\3"))
        coded = words.flatten().dictionary_encode()
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        del low, words  # the run's texts, twice
        chunks = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()  # to_pylist() makes a scalar of each
        self.new[b""] = b""
        left = self._unknown(set(chunks))
        if left:
            self.learn(left)
        ids = pa.array([*map(self.new.__getitem__, chunks), self.end], pa.binary())
        # each word's ids laid end to end, with an end after each text
        line = ids.take(pa.array(np.insert(coded.indices.to_numpy(), ends, len(chunks))))
        at = np.frombuffer(line.buffers()[1], np.int32)[: len(line) + 1]
        stop = at[ends + np.arange(1, len(ends) + 1)] // self.dtype.itemsize
        return np.frombuffer(line.buffers()[2] or b"", self.dtype)[: int(stop[-1]) if len(stop) else 0], np.diff(stop.astype(np.int64), prepend=0)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids and the end id, as little-endian bytes."""
        flat, n = self.encode_column(pa.array([t.decode() for t in texts], pa.string()))
        return [x.tobytes() for x in np.split(flat, np.cumsum(n)[:-1])] if len(texts) else []
