"""Secret scans: base patterns, and a linear-chain conditional random field over tokens, decoded by Viterbi.

Tokens are the runs between the six ASCII white-space bytes. Tags: O (outside), B (begins a secret), I (inside one).
Features: the token's shape, the words beside it, how near it stands after one that speaks of credentials, the file's.
Every token of a text is scored for all three tags, and the tags are those of the best path over the whole text. What
can't be B or I on a best path, by upper bounds on the paths to and from it, is O; the chain falls apart there, and
Viterbi runs over what is left give the best path of the whole.

The weights are fitted by maximum likelihood on at most `sample` texts of the table (of at most `SAMPLE_BYTES` bytes,
those with the smallest hash; tags from the base patterns) and on made-up lines with secrets in other wordings. Of the
table's texts the fit takes tokens that could be a code by shape or stand within `NEAR` tokens after a word of
credentials, with `FIT_MARGIN` tokens around them, and the first `FIT_PLAIN` tokens, in runs cut at `FIT_RUN` tokens.
These bounds hold for the fit alone; all tokens of all texts are scanned.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import mix64, records, table, text_runs, unpack

SAMPLE, SAMPLE_BYTES, FIT_RUN, FIT_MARGIN, FIT_PLAIN, NEAR = 2000, 20_000, 64, 2, 12, 6
#: Steps that bounds on paths are carried.
BOUND_STEPS = 4
KINDS = ("assign", "access", "hex", "crf")
#: On lower-cased bytes: its value class has both cases, so spans are those of the pattern without regard to case.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]{16,}"), re.compile(rb"[0-9a-f]{24,}")
WORDS = (b"password", b"passwd", b"passphrase", b"passcode", b"secret", b"token", b"apikey", b"api_key", b"key", b"bearer", b"credential", b"auth", b"pwd", b"private", b"login")
#: Words that stand between a name and its value, or go on with prose.
LINKS, PROSE = frozenset((b"is", b"was", b":", b"=", b"->", b"=>", b"are")), frozenset((b"the", b"a", b"an", b"to", b"of", b"for", b"and", b"or", b"in", b"on", b"be", b"must", b"not", b"with", b"that", b"this", b"it", b"has", b"have", b"your", b"my", b"by", b"at", b"from"))
TRIM = b"\"'`,;()[]{}<>|!?"
_ABOUT = re.compile(b"|".join(WORDS))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_LETTER = np.zeros(256, np.int32)
_LETTER[65:91] = _LETTER[97:123] = 1
#: For shapes: upper case, lower case or bytes of other scripts, digits are one sign each, others stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48
_HEX = np.isin(np.arange(256), list(b"0123456789abcdefABCDEF"))


def base_spans(text: bytes, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes. tokens: those of 20 or more bytes, which alone can hold access and hex matches.

    A run of the greedy patterns that is too short can't hold a longer match, so asking for the length at once gives the same matches.
    """
    low = text.lower()
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low) if m.end() - m.start(1) >= 6] if b":" in low or b"=" in low else []
    for a, b in tokens:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b)]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return out


def own_features(w: bytes) -> list[str]:
    core = w.strip(TRIM)
    v = re.split(rb"[=:]", core)[-1] or core
    n = len(v)
    digits, upper, lower = sum(48 <= c < 58 for c in v), sum(65 <= c < 91 for c in v), sum(97 <= c < 123 for c in v)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(v).values()) if n else 0
    shape = re.sub(rb"(.)\1+", rb"\1", re.sub(rb"[0-9]+", b"0", re.sub(rb"[a-z]+", b"a", re.sub(rb"[A-Z]+", b"A", re.sub(rb"[\x80-\xff]+", b"u", v)))))
    out = [f"len{min(n // 4, 12)}", f"entropy{min(int(entropy * 2), 11)}", f"digits{digits * 4 // max(n, 1)}", f"turns{min(len(shape) // 3, 8)}"]
    out += [k for k, on in (("hex", n >= 16 and all(c in b"0123456789abcdefABCDEF" for c in v)), ("mixed", bool(upper and lower and digits)), ("letters", not digits), ("other", digits + upper + lower < n * 0.8), ("mail", b"@" in w), ("url", b"//" in w or b"www." in w), ("akia", v.startswith(b"AKIA")), ("quoted", w[:1] in b"\"'`" and bool(w)), ("closes", w.rstrip(b".,:;")[-1:] in (b'"', b"'", b"`") and w[:1] not in b"\"'`"), ("wide", any(c > 127 for c in v)), ("dots", v.count(b".") >= 1), ("dashes", v.count(b"-") >= 2), ("prefix", core != v and any(k in core.lower() for k in WORDS))) if on]
    return out


def beside_features(w: bytes, side: str) -> list[str]:
    low = w.lower()
    return [f"{side}:{k}" for k, on in (("word", any(k in low for k in WORDS)), ("sign", low.endswith((b"=", b":"))), ("link", low.strip(TRIM) in LINKS), ("prose", low.strip(TRIM) in PROSE), ("none", not w), ("digits", any(48 <= c < 58 for c in w)), ("long", len(w) >= 16)) if on]


def place_features(w: bytes, since: int, before: bytes, before2: bytes) -> list[str]:
    """Of a token that stands near one that speaks of credentials: how near, and over what."""
    if not since:
        return ["far"]
    low, core = w.lower(), w.strip(TRIM)
    about = lambda x: any(k in x.lower() for k in WORDS)
    linked = before.lower().strip(TRIM) in LINKS and about(before2) or before.endswith((b":", b"=")) and about(before)
    kind = "digits" if core.isdigit() else "letters" if core.isalpha() else "mixed"
    out = [f"since{since}", f"{kind}:linked{int(linked)}", f"{kind}:long{min(len(core) // 4, 4)}:linked{int(linked)}"]
    return out + [k for k, on in (("own:link", low.strip(TRIM) in LINKS), ("own:prose", low.strip(TRIM) in PROSE), ("own:word", any(k in low for k in WORDS)), ("own:empty", not core), ("before2:link", before2.lower() in LINKS), ("linked:quoted", linked and w[:1] in b"\"'`")) if on]


def file_features(text: bytes) -> list[str]:
    low = text.lower()
    return [f"file:{k}" for k, on in (("words", any(k in low for k in WORDS[:6])), ("signs", low.count(b"=") * 100 > len(low)), ("short", len(low) < 500)) if on]


class Tokens:
    """Tokens of a run of texts, told apart by NumPy: starts, ends, texts, and which look like a secret to begin with (for the fit)."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        self.raw = data.tobytes()
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        digits, letters = np.cumsum(_DIGIT[data]), np.cumsum(_LETTER[data])
        n = self.end - self.start
        has = (digits[self.end - 1] > digits[self.start - 1]) & (letters[self.end - 1] > letters[self.start - 1])
        self.long = np.flatnonzero(n >= 20)
        self.first = np.cumsum([1, *[len(t) + 1 for t in texts]])  # byte where each text begins
        may = ((n >= 8) & has) | (n >= 20)
        self.since = np.zeros(len(n), np.int8)  # tokens since one that speaks of credentials, 0: none near
        cues = self._cues()
        end = self.start.searchsorted(self.first[self.first.searchsorted(self.start[cues], "right")], "left")  # where the cue's text ends
        for j in range(NEAR, 0, -1):
            near = cues[cues + j < end] + j
            self.since[near] = j
        self.hard = may | (self.since > 0)
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        self.points = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte

    def _cues(self) -> np.ndarray:
        low, found = self.raw.lower(), set()
        for w in WORDS:
            at = low.find(w)
            while at >= 0:
                i = int(self.start.searchsorted(at, "right")) - 1
                core = low[self.start[i] : self.end[i]].strip(TRIM + b":=.")
                if len(w) > 5 or re.fullmatch(rb"(?:[a-z_-]*[_-])?" + w + rb"s?(?:[:=_-].*)?", core):  # short ones as words of their own
                    found.add(i)
                at = low.find(w, at + len(w))
        return np.array(sorted(found), np.int64)

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]

    def coded(self) -> tuple[list[bytes], np.ndarray]:
        """Distinct words, and the number of each token's word. White space is cut away as pieces of its own."""
        cut = np.append(np.column_stack([self.start, self.end]).ravel(), len(self.raw)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(self.raw)])
        words = pieces.take(pa.array(np.arange(0, len(cut) - 1, 2))).dictionary_encode()
        return words.dictionary.to_pylist(), words.indices.to_numpy()


class Crf:
    """Weights of a linear chain with tags O, B, I."""

    def __init__(self, names: list[str], weight: np.ndarray, move: np.ndarray) -> None:
        self.at = {n: i for i, n in enumerate(names)}
        self.weight, self.move = weight, move

    def emit(self, features: list[str]) -> np.ndarray:
        e = self.weight[[self.at[f] for f in features if f in self.at]].sum(0)
        return e

    def _table(self, names: list[str]) -> np.ndarray:
        return np.array([self.emit([n]) for n in names])

    def words(self, words: list[bytes]) -> np.ndarray:
        """Scores [words, 9] of each word as the token, before it and after it: sums over own_features and beside_features."""
        cores = [w.strip(TRIM) for w in words]
        odd = [i for i, c in enumerate(cores) if b"=" in c or b":" in c]  # a name and a value: few
        n = np.fromiter(map(len, cores), np.int64, len(cores))
        ends, owner = np.cumsum(n), np.repeat(np.arange(len(cores)), n)
        data = np.frombuffer(b"".join(cores), np.uint8)

        def count(on: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(on)])
            return c[ends] - c[ends - n]

        shape = _SHAPE[data]
        turn = np.ones(len(data), bool)
        turn[1:] = (shape[1:] != shape[:-1]) | (owner[1:] != owner[:-1])
        digits, upper, lower = count(shape == 48), count(shape == 65), count((data >= 97) & (data <= 122))
        cell, c = np.unique(owner * 256 + data, return_counts=True)
        share = c / n[cell >> 8]
        entropy = np.bincount(cell >> 8, -share * np.log2(share), len(cores)) if len(cell) else np.zeros(len(cores))
        out = np.zeros((len(words), 9))
        own = out[:, :3]
        own += self.emit(["bias"])
        own += self._table([f"len{i}" for i in range(13)])[np.minimum(n // 4, 12)]
        own += self._table([f"entropy{i}" for i in range(12)])[np.minimum((entropy * 2).astype(np.int64), 11)]
        own += self._table([f"digits{i}" for i in range(5)])[digits * 4 // np.maximum(n, 1)]
        own += self._table([f"turns{i}" for i in range(9)])[np.minimum(count(turn) // 3, 8)]
        quote = (b'"', b"'", b"`")
        opens = np.fromiter((w[:1] in quote for w in words), bool, len(words))
        ended = np.fromiter((w.rstrip(b".,:;")[-1:] in quote for w in words), bool, len(words))
        every = lambda on: np.fromiter(on, bool, len(words))
        for name, on in (("hex", (n >= 16) & (count(_HEX[data]) == n)), ("mixed", (upper > 0) & (lower > 0) & (digits > 0)), ("letters", digits == 0), ("other", digits + upper + lower < n * 0.8), ("mail", count(data == 64) > 0), ("url", every(b"//" in w or b"www." in w for w in words)), ("akia", every(w.startswith(b"AKIA") for w in cores)), ("quoted", opens), ("closes", ended & ~opens), ("wide", count(data > 127) > 0), ("dots", count(data == 46) > 0), ("dashes", count(data == 45) >= 2)):
            own[on] += self.emit([name])
        for i in odd:
            own[i] = self.emit(["bias", *own_features(words[i])])
        low = [w.lower() for w in words]
        plain = [w.lower() for w in cores]
        begin = np.cumsum([0, *[len(w) + 1 for w in low]])
        about = np.zeros(len(words), bool)
        about[begin.searchsorted([m.start() for m in _ABOUT.finditer(b"\n".join(low))], "right") - 1] = True
        for name, on in (("word", about), ("sign", every(w.endswith((b"=", b":")) for w in words)), ("link", every(w in LINKS for w in plain)), ("prose", every(w in PROSE for w in plain)), ("none", every(not w for w in words)), ("digits", digits > 0), ("long", np.diff(begin) > 16)):
            out[on, 3:6] += self.emit([f"before:{name}"])
            out[on, 6:] += self.emit([f"after:{name}"])
        return out

    def emissions(self, tok: Tokens, texts: list[bytes]) -> np.ndarray:
        """Scores [tokens, 3] of every token: the sums of run_features' weights, word by word."""
        words, at = tok.coded()
        by = self.words([*words, b""])
        edge, out = by[-1], by[at, :3]
        first = np.diff(tok.doc, prepend=-1) > 0
        last = np.append(first[1:], True)[: len(first)]
        out += np.where(first[:, None], edge[3:6], by[np.roll(at, 1), 3:6])
        out += np.where(last[:, None], edge[6:], by[np.roll(at, -1), 6:])
        out += np.array([self.emit(file_features(t)) for t in texts])[tok.doc]
        out[tok.since == 0] += self.emit(["far"])
        for i in np.flatnonzero(tok.since).tolist():
            before = b"" if first[i] else tok.word(i - 1)
            before2 = b"" if first[i] or first[i - 1] else tok.word(i - 2)
            out[i] += self.emit(place_features(tok.word(i), int(tok.since[i]), before, before2))
        return out

    def outside(self, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Tokens that are O on every best path: by how much a path through B or I may at most exceed that through O is
        bounded for the way to a token and the way from it, over `BOUND_STEPS` tokens each."""
        n, m = len(e), self.move
        gain = e[:, 1:] - e[:, :1]
        first = np.diff(doc, prepend=-1) > 0
        last = np.append(first[1:], True)[:n]
        most_to = gain + (m[:, 1:] - m[:, :1]).max(0)
        most_from = np.tile((m[1:] - m[:1]).max(1), (n, 1))
        to, from_ = most_to, most_from
        for _ in range(BOUND_STEPS):
            before = np.where(first[:, None], -np.inf, np.roll(to, 1, 0))
            to = np.minimum(most_to, gain - m[0, 0] + np.maximum(m[0, 1:], np.maximum(before[:, :1] + m[1, 1:], before[:, 1:] + m[2, 1:])))
            after = np.where(last[:, None], -np.inf, np.roll(gain + from_, -1, 0))
            from_ = np.minimum(most_from, np.maximum(m[1:, 0], np.maximum(after[:, :1] + m[1:, 1], after[:, 1:] + m[1:, 2])) - m[0, 0])
        return (to + from_ < -1e-6).all(1)

    def viterbi(self, e: np.ndarray) -> list[int]:
        """Best tags of one run [tokens, 3] between two tokens that are O."""
        best, back = e[0] + self.move[0], []
        for row in e[1:]:
            s = best[:, None] + self.move
            back.append(s.argmax(0))
            best = s.max(0) + row
        tag = int((best + self.move[:, 0]).argmax())
        out = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            out.append(tag)
        return out[::-1]


def runs_of(tok: Tokens, some: np.ndarray) -> list[np.ndarray]:
    """Runs of neighbouring tokens of those marked in `some`, cut where a text ends."""
    at = np.flatnonzero(some)
    if not len(at):
        return []
    return np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(tok.doc[at]) > 0)) + 1)


def _fitted(tok: Tokens) -> np.ndarray:
    """Tokens of the table's texts that the fit takes."""
    some = tok.hard.copy()
    for j in range(1, FIT_MARGIN + 1):
        some[:-j] |= tok.hard[j:]
        some[j:] |= tok.hard[:-j]
    place = np.arange(len(some)) - np.searchsorted(tok.doc, tok.doc)
    return some | (place < FIT_PLAIN)


def _neighbours(tok: Tokens, i: int, doc: int) -> tuple[bytes, bytes]:
    before = tok.word(i - 1) if i and tok.start[i - 1] >= tok.first[doc] else b""
    after = tok.word(i + 1) if i + 1 < len(tok.start) and tok.start[i + 1] < tok.first[doc + 1] else b""
    return before, after


def run_features(tok: Tokens, run: np.ndarray, files: dict[int, list[str]], texts: list[bytes]) -> list[list[str]]:
    doc = int(tok.doc[run[0]])
    if doc not in files:
        files[doc] = file_features(texts[doc])
    out = []
    for i in run.tolist():
        before, after = _neighbours(tok, i, doc)
        before2 = _neighbours(tok, i - 1, doc)[0] if before else b""
        out.append(["bias", *own_features(tok.word(i)), *beside_features(before, "before"), *beside_features(after, "after"), *place_features(tok.word(i), int(tok.since[i]), before, before2), *files[doc]])
    return out


def made_up(count: int = 600, seed: int = 7) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Lines and their secrets (start, end), of a fixed generator: wordings that the base patterns don't match, and lines
    of the same words and shapes without a secret."""
    state = [np.uint64(seed)]

    def draw(n: int) -> int:
        with np.errstate(over="ignore"):
            state[0] = state[0] + np.uint64(0x9E3779B97F4A7C15)
        return int(mix64(np.array([state[0]], np.uint64))[0] >> np.uint64(11)) % n

    letters = b"abcdefghijklmnopqrstuvwxyz"
    every = letters + letters.upper() + b"0123456789"
    pick = lambda xs: xs[draw(len(xs))]
    word = lambda a, b: bytes(letters[draw(26)] for _ in range(a + draw(b)))
    code = lambda alphabet, n: bytes(alphabet[draw(len(alphabet))] for _ in range(n))
    name = (b"password", b"passphrase", b"passcode", b"secret key", b"private key", b"auth token", b"pwd", b"credential", b"login token", b"access key", b"secret", b"bearer token")
    link = (b"is", b"was", b"->", b"=>", b":", b"are")
    out = []
    for _ in range(count):
        prose = b" ".join(word(2, 9) for _ in range(4 + draw(4)))
        shape = draw(7)
        value = (lambda: code(every, 16 + draw(28)), lambda: code(b"0123456789abcdef", 32 + draw(20)), lambda: code(every[26:], 14 + draw(8)), lambda: word(3, 6).title() + code(b"0123456789", 2 + draw(4)) + code(b"!#%&", draw(2)), lambda: code(b"0123456789", 6 + draw(8)), lambda: b" ".join(word(3, 6) for _ in range(3 + draw(2))), lambda: word(9, 8))[shape]()
        if shape == 5:  # words are a secret where quotes hold them together
            lead, value, quote = pick(name[:3]) + b" " + pick(link), b'"' + value + b'"', b""
        elif shape in (4, 6):
            lead, quote = pick((b"my ", b"the ", b"")) + pick(name) + b" " + pick(link), b'"' if shape == 6 else pick((b"", b'"'))
        else:
            lead, quote = pick((pick(name) + b" " + pick(link), b"Authorization: Bearer", b"Bearer", pick(name), b"my " + pick(name) + b" " + pick(link))), pick((b"", b'"', b"`"))
        head = prose + b" " + lead + b" " + quote
        span = (len(head) + (shape == 5), len(head) + len(value) - (shape == 5))
        out.append((head + value + quote + pick((b" ", b", ", b". ")) + word(2, 8) + b" " + word(2, 8), [span]))
        plain = (lambda: word(20, 16), lambda: word(9, 9) + code(b"0123456789", 2), lambda: word(3, 6) + b".%d@mail.example" % draw(99), lambda: b"http://" + word(4, 8) + b".example/%d" % draw(9999), lambda: b"ISO-%d-rev%d" % (draw(9999), draw(9)), lambda: b"+33-%d-tel" % draw(10**8), lambda: word(5, 9) + b"!!" + word(9, 9))
        about = (lambda: pick(name) + b" " + pick(link[:2]) + b" " + pick((b"not", b"a", b"the", b"to", b"of", b"in")) + b" " + word(3, 7), lambda: b"the " + pick(name) + b" of " + word(3, 8) + b" and " + word(3, 8), lambda: pick(name) + b" " + word(3, 8) + b" " + word(3, 8), lambda: pick(name) + b" " + pick(link[:2]) + b" " + word(4, 5), lambda: b"in %d the " % (1900 + draw(130)) + pick(name) + b" " + word(4, 6))
        head = prose + b' token = "'
        value = code(b"0123456789abcdef", 32 + draw(20))
        if draw(3) == 0:  # prose goes on after a plain assignment
            out.append((head + value + b'" ' + word(2, 8) + pick((b" ", b" was ", b" is ")) + word(8, 9) + b", " + word(4, 9), [(len(head), len(head) + len(value))]))
        out.append((prose + b" " + pick(plain)() + b" " + word(2, 8), []))
        out.append((prose + b" " + pick(about)() + pick((b" ", b", ")) + word(2, 8) + b" " + word(2, 8), []))
    return out


def _cases(group: list[bytes], secrets: list[list[tuple[int, int]]] | None) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Features and tags of runs of tokens; a token is B or I where a secret (by default: a base span) covers its middle.
    Of texts whose secrets are given all tokens are taken."""
    tok = Tokens(group)
    files: dict[int, list[str]] = {}
    known: dict[int, list[tuple[int, int]]] = {}
    for run in runs_of(tok, _fitted(tok) if secrets is None else np.ones(len(tok.start), bool)):
        doc = int(tok.doc[run[0]])
        if doc not in known:
            mine = tok.long[(tok.start[tok.long] >= tok.first[doc]) & (tok.start[tok.long] < tok.first[doc + 1])]
            known[doc] = secrets[doc] if secrets is not None else [(a, b) for a, _, b in base_spans(group[doc], [(int(tok.start[i] - tok.first[doc]), int(tok.end[i] - tok.first[doc])) for i in mine])]
        holder = []
        for i in run.tolist():
            middle = (int(tok.start[i]) + int(tok.end[i])) // 2 - int(tok.first[doc])
            holder.append(next((s for s in known[doc] if s[0] <= middle < s[1]), None))
        tags = [0 if h is None else 2 if j and holder[j - 1] == h else 1 for j, h in enumerate(holder)]
        features = run_features(tok, run, files, group)
        for a in range(0, len(tags), FIT_RUN):
            yield features[a : a + FIT_RUN], tags[a : a + FIT_RUN]


def fit(texts: list[bytes], rounds: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by AdaGrad. Runs are batched by length, features are kept as lists of indexes."""
    invented = made_up()
    cases = [*(_cases(texts, None) if texts else ()), *_cases([t for t, _ in invented], [s for _, s in invented])]
    cases.sort(key=lambda c: len(c[1]))
    names = sorted({f for fs, _ in cases for one in fs for f in one})
    at = {n: i for i, n in enumerate(names)}
    count = np.array([len(t) for _, t in cases])
    flat = np.array([at[f] for fs, _ in cases for one in fs for f in one], np.int64)
    sizes = np.array([len(one) for fs, _ in cases for one in fs])
    first, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    tag = np.array([t for _, ts in cases for t in ts])
    begin = np.cumsum(count) - count
    heavy = 1 + 2.0 * np.array([any(ts) for _, ts in cases])
    weight = np.repeat(heavy, count)
    # the tag before each token and after the last one of a run is O
    before = np.where(np.isin(np.arange(len(tag)), begin), 0, np.roll(tag, 1))
    gold_move = np.zeros((3, 3))
    np.add.at(gold_move, (before, tag), weight)
    np.add.at(gold_move, (tag[begin + count - 1], 0), heavy)
    groups = [np.flatnonzero(count == n) for n in np.unique(count)]
    w, move = np.zeros((len(names), 3)), np.zeros((3, 3))
    gw, gm = np.full_like(w, 1e-6), np.full_like(move, 1e-6)
    for _ in range(rounds):
        e = np.add.reduceat(w[flat], first)
        node, want = np.zeros_like(e), np.zeros((3, 3))
        for g in groups:
            n = int(count[g[0]])
            cell = begin[g][:, None] + np.arange(n)
            x, mass = e[cell], heavy[g][:, None, None]
            alpha, beta = np.zeros_like(x), np.zeros_like(x)
            alpha[:, 0] = move[0] + x[:, 0]
            for j in range(1, n):
                alpha[:, j] = np.logaddexp.reduce(alpha[:, j - 1][:, :, None] + move, axis=1) + x[:, j]
            beta[:, -1] = move[:, 0]
            for j in range(n - 2, -1, -1):
                beta[:, j] = np.logaddexp.reduce(move[None] + (x[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2)
            total = np.logaddexp.reduce(alpha[:, -1] + move[:, 0], axis=1)
            p = np.exp(alpha + beta - total[:, None, None])
            node[cell] = p
            want[0] += (p[:, 0] * heavy[g][:, None]).sum(0)
            want[:, 0] += (p[:, -1] * heavy[g][:, None]).sum(0)
            for j in range(1, n):
                want += (np.exp(alpha[:, j - 1][:, :, None] + move + (x[:, j] + beta[:, j])[:, None, :] - total[:, None, None]) * mass).sum(0)
        miss = (np.eye(3)[tag] - node) * weight[:, None]
        dw = np.stack([np.bincount(flat, miss[owner, t], len(names)) for t in range(3)], 1) / len(cases) - decay * w
        dm = (gold_move - want) / len(cases) - decay * move
        gw, gm = gw + dw * dw, gm + dm * dm
        w, move = w + rate * dw / np.sqrt(gw), move + rate * dm / np.sqrt(gm)
    return Crf(names, w, move)


def scan(texts: list[bytes], crf: Crf) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text: base spans and all spans as (start, kind, end) in code points, in order."""
    tok = Tokens(texts)
    base: list[list[tuple[int, int, int]]] = []
    holder = tok.doc[tok.long]
    cut = np.searchsorted(holder, np.arange(len(texts) + 1))
    for d, t in enumerate(texts):
        f = int(tok.first[d])
        base.append(base_spans(t, [(int(tok.start[i]) - f, int(tok.end[i]) - f) for i in tok.long[cut[d] : cut[d + 1]]]))
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    scores = crf.emissions(tok, texts) if len(tok.start) else np.zeros((0, 3))
    for run in runs_of(tok, ~crf.outside(scores, tok.doc)):
        tags = crf.viterbi(scores[run])
        doc = int(tok.doc[run[0]])
        at = int(tok.first[doc])
        spans: list[list[int]] = []
        for i, tag in zip(run.tolist(), tags, strict=True):
            w = tok.word(i)
            if not tag or not w.strip(TRIM + b".:"):
                continue
            a = int(tok.start[i]) - at + len(w) - len(w.lstrip(TRIM))
            b = int(tok.end[i]) - at - len(w) + len(w.rstrip(TRIM + b".:"))
            if tag == 2 and spans and spans[-1][2] == i - 1:
                spans[-1][1:] = [b, i]
            else:
                spans.append([a, b, i])
        added[doc] += [(a, 3, b) for a, b, _ in spans if not any(x < b and a < y for x, _, y in base[doc])]
    out = []
    for d in range(len(texts)):
        f = int(tok.first[d])
        zero = int(tok.points[f - 1])
        point = lambda p: int(tok.points[f + p - 1]) - zero  # noqa: B023, E731
        move = lambda s: sorted((point(a), k, point(b)) for a, k, b in s)  # noqa: B023, E731
        out.append((move(base[d]), move(base[d] + added[d])))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The input's columns with `secrets`: an array of (kind, start, end), in code points, end exclusive.

    Null and empty texts have none, an empty table no rows; texts of any length are scanned whole; repeated rows have
    the same spans each. Kinds assign, access and hex are matches of the base patterns; crf are the model's, where they
    don't touch a base span. Spans at one place are in the order of the kinds. An input column `secrets` gives way.
    """
    hold = df.select(F.col(f"`{text}`").cast("string").alias("t")).where(f"octet_length(t) <= {SAMPLE_BYTES}").withColumn("h", F.xxhash64("t"))
    low = [r["h"] for r in hold.select("h").distinct().orderBy("h").limit(sample).collect()]  # only hashes are sorted
    some = hold.where(F.col("h") <= low[-1]).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect() if low else []
    texts = [r["t"].encode() for r in some]
    crf = fit(texts)
    weights = (list(crf.at), crf.weight, crf.move)
    base = records(df, F.col(f"`{text}`").alias("__text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Crf(*weights)
        for batch in batches:
            for part, part_texts in text_runs(batch, "__text"):
                found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in every] for _, every in scan(part_texts, model)]
                yield pa.RecordBatch.from_arrays([part.column("rec"), pa.array(found, kind)], names=["rec", "secrets"])

    return unpack(base.mapInArrow(run, T.StructType([base.schema["rec"], T.StructField("secrets", span)])), df.columns, secrets="secrets")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base matches, the digest of base spans and all spans of every text of `documents`."""
    got = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(show(base), 256).alias("base_sha256"), show(F.col("secrets")).alias("spans"))
