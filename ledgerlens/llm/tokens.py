"""Token ids of whole texts by the ``tokenizers`` library, with a bounded
cache of the ids of white-space separated pieces.

A byte-level pre-tokenizer never joins a non-space character with a later
white-space one, and takes at most one leading space into a word.  So a text
cut before the last white-space character in front of each word encodes to
the concatenation of its pieces.  Texts holding the added tokens' strings or
white space beyond ASCII go through the library whole, as all texts do if the
tokenizer has a normalizer or another pre-tokenizer.

Pieces are numbered; their ids lie in one array, and a group of texts is put
together from it by numpy.  Texts without longer runs of white space are cut
at every space and newline by Arrow, which also finds their different words and
parts words from the punctuation after them.  The cache belongs to its task and
is emptied when it holds ``CACHE_BYTES``.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = re.compile(r"[\t-\r ]?[^\t-\r ]+|[\t-\r ]+(?=[\t-\r ][^\t-\r ])|[\t-\r ]+")
SAFE_CUT = re.compile(r"(?<=[0-9A-Za-z])(?= [0-9A-Za-z])")
# white space beyond ASCII, and the separators Python counts as such
WIDE_SPACE = "".join(map(chr, [*range(0x1c, 0x20), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                               0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))
MARK = "\x1c"  # leads the key of a piece that is itself; other keys have one space before them, or begin with white space
# letters, then punctuation: two tokens' worth for the pre-tokenizer
TAILED = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]+)")
PUNCTUATION = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
LETTER = "".join(filter(LETTERS.fullmatch, map(chr, range(256))))
# how a byte-level vocabulary writes bytes that are no visible Latin-1 characters, but for the newline
BYTE_LETTERS = np.arange(256, dtype="<u2")
BYTE_LETTERS[[*range(0x21), *range(0x7f, 0xa1), 0xad]] = np.arange(256, 324)
BYTE_LETTERS[10] = 10
CACHE_BYTES = 96 << 20
LEARN = 32_768     # pieces a library call; its working memory follows them
ENTRY_BYTES = 160  # of a piece beside its characters and ids
SLICE_CHARS = 1 << 18


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file (its folder is on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(text: str, size: int = SLICE_CHARS):
    """Parts of about ``size`` characters, cut between two ASCII words."""
    at = 0
    while len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@lru_cache(maxsize=1)
def _vocabulary(path: str):
    """The tokenizer, the same model behind a plain split at white space, the
    byte width of each id, and patterns of texts that cannot be cut, or not at
    every space: one a worker, of a fixed size."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would keep memory of their own
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    vocab = tok.get_vocab(with_added_tokens=False)
    width = np.zeros(max(vocab.values()) + 1, np.int64)
    for piece, i in vocab.items():
        width[i] = len(piece)
    pre = tok.pre_tokenizer
    cut = tok.normalizer is None and isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    never = re.compile("|".join([f"[{WIDE_SPACE}]", *map(re.escape, added)]) if cut else "(?s:.*)")
    # the same for Arrow, with the white space that a cut at every space or newline would part
    odd = "|".join([f"[{''.join(map(_hex, WIDE_SPACE))}\\t\\x0b\\f\\r]", "[ \\n][ \\n][ \\n]", "[ \\n][ \\n]$",
                    *("".join(map(_hex, t)) for t in added)]) if cut else ""
    plain = Tokenizer(tok.model)
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return tok, plain, width, never, odd


def _hex(char: str) -> str:
    return f"\\x{{{ord(char):x}}}"


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _key(chunk: str) -> str:
    if chunk.isspace() or chunk[0] not in "\t\n\v\f\r ":
        return MARK + chunk
    return chunk[1:] if chunk[0] == " " else chunk


_ODD = ("", MARK, "\t", "\n", "\v", "\f", "\r")


def _text(key: str) -> str:
    if key[:1] == MARK:
        return key[1:]
    return key if key[:1] in ("\t", "\n", "\v", "\f", "\r") else f" {key}"


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype, size: int = 1 << 12):
        self.data, self.n = np.zeros(size, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        stop = self.n + len(values)
        if stop > len(self.data):
            grown = np.zeros(max(stop, 2 * len(self.data)), self.data.dtype)
            grown[:self.n] = self.data[:self.n]
            self.data = grown
        self.data[self.n:stop] = values
        self.n = stop


class ChunkEncoder:
    """``encode(texts)``: per text its ids as one numpy array."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.tok, self.plain, self.width, self.never, self.odd = _vocabulary(path)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.limit = cache_bytes
        self._empty()

    def _empty(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.count = _Grown(self.dtype), _Grown(np.int64), _Grown(np.int64)
        self.bytes = 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, keys, ids: np.ndarray, counts: np.ndarray) -> None:
        """Number keys whose ids follow each other in ``ids``."""
        first = self.start.n
        self.number.update(zip(keys, range(first, first + len(counts))))
        self.start.extend(self.ids.n + np.cumsum(counts) - counts)
        self.count.extend(counts)
        self.ids.extend(ids)
        self.bytes += ids.nbytes + ENTRY_BYTES * len(counts) + sum(map(len, keys))

    def _add_each(self, keys: list[str], ids: list[np.ndarray]) -> None:
        if keys:
            self._add(keys, np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn(self, keys: list[str]) -> None:
        """Ids of unseen pieces.  Letters and the punctuation after them are
        learned apart, so a word is looked up once whatever follows it."""
        whole, tailed, words, tails = [], [], [], []
        for k in keys:
            m = TAILED.fullmatch(k) if k[-1:] in PUNCTUATION else None
            if m:
                tailed.append(k)
                words.append(m[1])
                tails.append(MARK + m[2])
            else:
                whole.append(k)
        parts = set(words).union(tails).difference(self.number, whole)
        odd = [k for k in whole if k[:1] in _ODD]
        if odd:
            whole = [k for k in whole if k[:1] not in _ODD]
            odd += [k for k in parts if k[:1] == MARK]
            self._learn_each(odd)
        letters, other = [], []
        for k in [*whole, *(k for k in parts if k not in self.number and k[:1] != MARK)]:
            (letters if LETTERS.fullmatch(k) else other).append(k)
        self._learn_letters(letters)
        self._learn_words(other)
        self._learn_each([k for k in parts if k[:1] == MARK and k not in self.number])
        if tailed:
            pairs = np.empty(2 * len(tailed), np.int64)
            for at, side in enumerate((words, tails)):
                pairs[at::2] = np.fromiter(map(self.number.__getitem__, side), np.int64, len(side))
            ids, counts = self._gather(pairs)
            self._add(tailed, ids, counts.reshape(-1, 2).sum(axis=1))

    def _learn_each(self, keys: list[str]) -> None:
        """Pieces with white space or nothing in front: a few, one by one."""
        keys = list(dict.fromkeys(keys))
        if keys:
            self._add_each(keys, self._library([_text(k) for k in keys]))

    def _learn_letters(self, keys: list[str]) -> None:
        """Words of Latin letters with a space before them.  Each is one word to
        a byte-level pre-tokenizer, which writes every byte, the space's too, as
        a letter: the model needs no more."""
        if not keys:
            return
        raw = np.frombuffer((" " + "\n ".join(keys)).encode(), np.uint8)
        ids = np.array(self.plain.encode_batch_fast([BYTE_LETTERS[raw].tobytes().decode("utf-16-le")],
                                                    add_special_tokens=False)[0].ids, self.dtype)
        at = np.concatenate([[0], np.cumsum(self.width[ids])])
        newlines = np.flatnonzero(raw == 10)
        ends = np.append(newlines - np.arange(len(newlines)), len(raw) - len(newlines))
        hi = np.searchsorted(at, ends)
        if hi[-1] == len(ids) and (at[hi] == ends).all():
            self._add(keys, ids, np.diff(hi, prepend=0))
        else:
            self._learn_words(keys)

    def _learn_words(self, keys: list[str]) -> None:
        """One library call over words with a space before them, parted by
        newlines (own tokens there), cut where the tokens' bytes reach a
        word's end."""
        if not keys:
            return
        ids = self._library([" " + "\n ".join(keys)])[0]
        at = np.concatenate([[0], np.cumsum(self.width[ids])])
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, keys)), np.int64, len(keys)) + 2) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        lo, hi = np.searchsorted(at, begins), np.searchsorted(at, ends)
        if ((at[lo] == begins) & (at[hi] == ends)).all():
            # the newlines between stay in the array, in no piece
            first = self.ids.n
            self._add(keys, ids, hi - lo)
            self.start.data[self.start.n - len(keys):self.start.n] = first + lo
        else:
            self._add_each(keys, self._library([f" {k}" for k in keys]))

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and how many each has."""
        counts = self.count.data[numbers]
        shift = self.start.data[numbers] - (np.cumsum(counts) - counts)
        return self.ids.data[np.repeat(shift, counts) + np.arange(int(counts.sum()))], counts

    def _pieces(self, text: str) -> list[str]:
        """Keys of the pieces of a text that cannot be cut at every space."""
        keys: list[str] = []
        for part in slices(text):
            if self.never.search(part):  # the library must see it whole: a number of its own, no text has such a key
                keys.append(f"{MARK}{MARK}{len(self.number)}")
                self._add_each(keys[-1:], self._library([part]))
            else:
                keys += map(_key, CHUNK.findall(part))
        return keys

    def _numbers(self, keys: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
        unseen = np.flatnonzero(out < 0)
        if len(unseen):
            wanted = [keys[k] for k in unseen.tolist()]
            new = list(dict.fromkeys(wanted))
            for at in range(0, len(new), LEARN):
                self._learn([k for k in new[at:at + LEARN] if k not in self.number])
            out[unseen] = np.fromiter(map(self.number.__getitem__, wanted), np.int64, len(wanted))
        return out

    def _words(self, keys: list[str]) -> np.ndarray:
        """Numbers of different words of Latin letters with a space before them."""
        out = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
        unseen = np.flatnonzero(out < 0)
        new, first = [keys[k] for k in unseen.tolist()], self.start.n
        for at in range(0, len(new), LEARN):
            self._learn_letters(new[at:at + LEARN])
        out[unseen] = first + np.arange(len(new))
        return out

    def _different(self, keys: pa.Array) -> tuple[np.ndarray, tuple[int, ...]]:
        """Numbers of a group's different pieces, and how far those reach that
        stay.  Words with punctuation after them are put together from both,
        for this group only."""
        out = np.empty(len(keys), np.int64)
        word, tailed = (pc.match_substring_regex(keys, f"^(?:{p.pattern})$").to_numpy(zero_copy_only=False)
                        for p in (LETTERS, TAILED))
        both = keys.filter(pa.array(tailed))
        heads = pc.utf8_rtrim(both, characters="".join(PUNCTUATION))
        tails = pc.utf8_ltrim(both, characters=LETTER).dictionary_encode()
        words = pa.concat_arrays([keys.filter(pa.array(word)), heads]).dictionary_encode()
        other = np.flatnonzero(~(word | tailed))
        out[other] = self._numbers(_strings(keys.take(pa.array(other))))
        tail = self._numbers([MARK + t for t in _strings(tails.dictionary)])[tails.indices.to_numpy()]
        number = self._words(_strings(words.dictionary))[words.indices.to_numpy()]
        out[word], head = np.split(number, [len(number) - len(both)])
        stay = self.ids.n, self.start.n, self.count.n, self.bytes
        ids, counts = self._gather(np.column_stack([head, tail]).reshape(-1))
        out[tailed] = self.start.n + np.arange(len(both))
        self._add((), ids, counts.reshape(-1, 2).sum(axis=1))
        return out, stay

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Texts that can be cut at every space are split and their different
        pieces found by Arrow; Python sees each different piece once."""
        if self.bytes > self.limit:
            self._empty()
        whole = pa.array(texts, pa.large_string())
        odd = pc.or_(pc.match_substring_regex(whole, self.odd), pc.greater(pc.utf8_length(whole), SLICE_CHARS))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = self._numbers(self._pieces(texts[k]))
        plain, stay = np.flatnonzero(~odd), None
        if len(plain):
            cut = pc.split_pattern(pc.replace_substring(whole.take(pa.array(plain)), "\n", " \n"), " ")
            coded = cut.flatten().dictionary_encode()
            begins = np.cumsum([0, *pc.list_value_length(cut).to_numpy().tolist()])
            # a text's first piece has no space before it
            first = coded.dictionary.take(coded.indices.take(pa.array(begins[:-1]))).to_pylist()
            first = self._numbers([MARK + f for f in first])
            numbers, stay = self._different(coded.dictionary)
            numbers = numbers[coded.indices.to_numpy()]
            numbers[begins[:-1]] = first
            for k, a, b in zip(plain.tolist(), begins.tolist(), begins[1:].tolist()):
                out[k] = numbers[a:b]
        pieces = np.fromiter(map(len, out), np.int64, len(out))
        ids, counts = self._gather(np.concatenate(out) if out else np.zeros(0, np.int64))
        if stay:
            self.ids.n, self.start.n, self.count.n, self.bytes = stay
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(pieces)]
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def encoder(path: str) -> ChunkEncoder:
    """A task's own encoder."""
    return ChunkEncoder(path)


def encode_column(batches, path: str, text: str = "text", group_chars: int = 1 << 21):
    """Yield ``(row values, ids)`` for each row, encoding about
    ``group_chars`` characters of texts at a time."""
    enc = encoder(path)
    for cols in batches:
        names, texts = list(cols), cols[text]
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and chars < group_chars:
                chars += len(texts[j] or "")
                j += 1
            for k, ids in enumerate(enc.encode([t or "" for t in texts[i:j]]), i):
                yield {n: cols[n][k] for n in names if n != text}, ids
            i = j
