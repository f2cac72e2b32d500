"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that BPE
produces.  It starts with one state that loops on every base symbol; each
merge (u, v) -> w is compiled by its gadget, in order: wherever an arc u
enters a state with an arc v, a new arc w bridges the two, and u is led to a
copy of that state without the arc v.  Since every u arc enters the same
state, the state after a token is a chain of such copies: the compiled tables
hold, per token, that state, and per state the arcs it lost and when.

A token is missing from a state if a symbol on its left edge was lost before
the token that covers it was made.  So walking a word needs two table
look-ups per arc.  Of all arc sequences that spell a word exactly one is
accepted; encoding walks the longest arcs first and steps back where it must.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, renamed

CACHE_WORDS = 400_000
GROUP_CHARS = 1 << 22
SPACES = re.compile(r"[^\t-\r ]+")
# Runs that need no library call to be split: printable ASCII and the letters of
# Latin-1 (composed, lower-cased one to one), by the splitting pattern below.
LATIN = "a-zA-Z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF)))
PLAIN = re.compile(f"[!-~{LATIN}]+")
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^{LATIN}0-9]+")


def byte_symbols() -> dict[int, int]:
    """The byte alphabet: printable bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


class Automaton:
    """Compiled from ``vocab`` (label -> id) and ``merges`` in order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.made: dict[str, int] = {}              # token -> number of the merge that made it
        self.left: dict[str, str] = {}
        # a state is a chain: (state it was copied from, token lost, merge number)
        self.chain: list[tuple[int, str, int]] = [(-1, "", -1)]
        self.state: dict[str, int] = {}             # token -> state its arcs enter (else 0)
        for number, (u, v) in enumerate(merges):
            self._gadget(number, u, v)
        self.lost = {k: self._lost(k) for k in set(self.state.values())}
        base = {t for t in vocab if len(t) == 1 or end and t.endswith(end) and len(t) == len(end) + 1}
        self.arcs = base | self.made.keys()
        self.longest = max(map(len, self.arcs), default=1)

    def _gadget(self, number: int, u: str, v: str) -> None:
        w, before = u + v, self.state.get(v, 0)
        # nothing to bridge if no path holds u and then v (the merge never applies)
        if w not in self.vocab or w in self.made or not self._arc(self._lost(self.state.get(u, 0)), v):
            return
        self.made[w], self.left[w] = number, u
        self.state[w] = before                      # the bridge ends where v ended
        self.chain.append((self.state.get(u, 0), v, number))
        self.state[u] = len(self.chain) - 1         # u is led to the copy without v

    def _lost(self, state: int) -> dict[str, int]:
        """The tokens a state lost -> the numbers of the merges that took them."""
        out: dict[str, int] = {}
        while state > 0:
            state, token, number = self.chain[state]
            out[token] = number
        return out

    def _arc(self, lost: dict[str, int], token: str) -> bool:
        at, made = token, 1 << 62
        while lost:
            if lost.get(at, made + 1) <= made:
                return False
            if at not in self.left:
                break
            made, at = self.made[at], self.left[at]
        return True

    def has_arc(self, before: str, token: str) -> bool:
        """Whether the state after ``before`` has an arc ``token``."""
        return self._arc(self.lost.get(self.state.get(before, 0), {}), token)

    def encode(self, symbols: str) -> list[str]:
        """Labels of the accepted path that spells a non-empty word of base
        symbols; the end mark belongs to the last one.

        The walk takes the longest arc that goes on spelling the word, and
        steps back where none does.  One accepted path at most spells a
        prefix, so a position left once is never entered again."""
        n, end, arcs, states, tables = len(symbols), self.end, self.arcs, self.state, self.lost
        path: list[str] = []
        at, size, dead = 0, self.longest, [False] * (n + 1)
        while at < n:
            lost = tables.get(states.get(path[-1], 0)) if path else None
            for size in range(min(size, n - at), 0, -1):
                stop = at + size
                token = symbols[at:stop] if stop < n else symbols[at:] + end
                if token in arcs and not dead[stop] and (not lost or self._arc(lost, token)):
                    path.append(token)
                    at, size = stop, self.longest
                    break
            else:
                if not path:
                    raise ValueError(f"no path spells {symbols!r}")
                dead[at] = True
                size = len(path.pop())
                at, size = at - size, size - 1
        return path


class Codec:
    """Encoder and decoder for one tokenizer file (BPE over byte symbols,
    words ended by ``end_of_word_suffix``, no unknown token).

    The library's own normalizer and pre-tokenizer split the text; the words
    go through the automaton.  Its ``decode`` without a decoder joins the
    labels with blanks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or spec["decoder"] is not None:
            raise ValueError("a BPE model without prefixes and without a decoder is needed")
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.auto = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        tok = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tok.normalizer, tok.pre_tokenizer
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.plain = SPLIT in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.symbols = byte_symbols()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.words: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}

    def _word(self, symbols: str) -> tuple[bytes, str]:
        found = self.words.get(symbols)
        if found is None:
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            labels = self.auto.encode(symbols)
            found = np.array([self.auto.vocab[t] for t in labels], "<u4").tobytes(), " ".join(labels)
            self.words[symbols] = found
        return found

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids and decoded labels of a run without white space; no word
        reaches beyond one."""
        ids, labels = [], []
        if self.plain and PLAIN.fullmatch(chunk) and not self.special.search(chunk):
            for word in PLAIN_SPLIT.findall(chunk.lower()):
                i, text = self._word(word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols))
                ids.append(i)
                labels.append(text)
            return b"".join(ids), " ".join(labels)
        for k, part in enumerate(self.special.split(chunk)):
            if k % 2:
                ids.append(np.array([self.added[part]], "<u4").tobytes())
                labels.append(part)
            elif part:
                part = self.normalizer.normalize_str(part) if self.normalizer else part
                for symbols, _ in self.pre_tokenizer.pre_tokenize_str(part):
                    i, text = self._word(symbols)
                    ids.append(i)
                    labels.append(text)
        return b"".join(ids), " ".join(labels)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids (little-endian unsigned 32-bit) and decoded text of a whole text."""
        chunks = SPACES.findall(text or "")
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.clear()
        for c in set(chunks):
            if c not in self.chunks:
                self.chunks[c] = self._chunk(c)
        found = [self.chunks[c] for c in chunks]
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row; null text counts as
    empty (no ids, empty text)."""

    def run(batches):
        own = codec(tokenizer)
        for cols in batches:
            for doc, text in zip(cols["doc_id"], cols["text"]):
                ids, decoded = own.encode(text)
                yield doc, len(ids) // 4, ids, decoded

    return map_rows(renamed(docs, doc_id=id_col, text=text_col), run,
                    "doc_id long, n_tokens long, ids binary, decoded string")
