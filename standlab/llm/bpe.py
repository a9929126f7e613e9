"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

Encoding of one pre-token (Python needs no merge queue for it):

* The longest token that starts at a place is found by hashes of its possible lengths, longest first,
  and only at places the encoder comes to.
* A sequence of tokens is what merging would give exactly if each two neighbours are compatible,
  that is if merging their joined text leaves just these two.  Compatibility of a pair is found by
  undoing merges on both sides of the seam and is kept in a table.
* The encoder walks left to right with the longest match; where that is incompatible with the
  token before, it takes the next shorter token, and where none is left it goes back one token.
  Places from which no continuation exists are marked and never entered twice, so the time is
  linear in the text.

A token that is not the result of its own merges is never used (it cannot come out of merging).
The last piece of a pre-token carries the end-of-word suffix, as part of the alphabet.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import functions as F

from standlab.llm.registry import register
from standlab.llm.tables import table

KEPT = 1 << 18  # pre-tokens remembered by a task; beyond it the memory starts anew
PAIRS = 1 << 20


def byte_letters() -> list[str]:
    """The printable letter of each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class Encoder:
    """Encoder and decoder of a byte-level vocabulary with an end-of-word suffix.

    ``never`` holds the tokens that do not come out of their own merges, where an encoder of the same
    file has found them; else they are found here.
    """

    def __init__(self, config: dict, never: frozenset[str] | None = None):
        model = config["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.parts: dict[str, tuple[str, str]] = {}
        for left, right in merges:
            joined = left + right
            if joined in self.vocab:
                self.parts.setdefault(joined, (left, right))
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        split = next(p for p in config["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # the same classes within ASCII, for the library that is faster but lacks them
        plain = split["pattern"]["Regex"]
        for wide, narrow in ((r"\p{L}", "a-zA-Z"), (r"\p{N}", "0-9"), (r"\s", r" \t\n\r\f\v")):
            plain = plain.replace(wide, narrow)
        self.ascii_pattern = re.compile(plain) if "\\p" not in plain else self.pattern
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) \
            if self.special else None
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.never = frozenset(t for t in self.vocab if not self._own(t)) if never is None else never
        self._lookup()
        self._offsets()

    # -- vocabulary -----------------------------------------------------------------------
    def _units(self, word: str) -> list[str]:
        """The alphabet symbols of a byte-lettered word; the last one carries the suffix."""
        return [*word[:-1], word[-1] + self.suffix] if word else []

    def _merged(self, units: list[str]) -> list[str]:
        """Plain merging, used once for each token of the vocabulary."""
        while len(units) > 1:
            best = min(((self.rank.get(p, 1 << 40), i) for i, p in enumerate(zip(units, units[1:]))))
            if best[0] == 1 << 40:
                break
            i = best[1]
            units = [*units[:i], units[i] + units[i + 1], *units[i + 2:]]
        return units

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            return self._units(token[:-len(self.suffix)])
        return list(token)

    def _own(self, token: str) -> bool:
        units = self._symbols(token)
        return len(units) == 1 or token in self.parts and self._merged(units) == [token]

    def _lookup(self) -> None:
        """All reachable tokens: those with the suffix, which end a word, and the others."""
        ends = {t for t in self.vocab if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix)}
        self.closing = ends - self.never
        self.inner = self.vocab.keys() - ends - self.never
        self.longest = max(map(len, self.inner), default=0)

    def _offsets(self) -> None:
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        texts = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.table = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        self.start, self.size = np.cumsum(size) - size, size
        self.digits = [str(i) for i in range(len(size))]

    # -- one pre-token --------------------------------------------------------------------
    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two tokens leaves exactly these two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: str, right: str) -> bool:
        """Undo merges at the seam, latest first; a merge across it that is due earlier than one
        of the two undone merges would have happened in place of it."""
        limit = 1 << 40
        while True:
            across = self.rank.get((left, right), 1 << 40)
            if across < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            rank_a = self.rank[a] if a else -1
            rank_b = self.rank[b] if b else -1
            if a is None and b is None:
                return True
            if rank_a > rank_b or rank_a == rank_b and a is not None and b is None:
                # a merge across the seam with the same rank as the left one comes after it
                limit, left = rank_a, a[1]
                if self.rank.get((left, right), 1 << 40) < limit:
                    return False
            else:
                # of equal ranks the leftmost goes first, so across the seam comes before right
                limit, right = rank_b + 1, b[0]
                if self.rank.get((left, right), 1 << 40) < limit:
                    return False

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token, given in byte letters."""
        n, suffix, inner, known = len(word), self.suffix, self.inner, self.pairs
        out: list[str] = []
        sizes: list[int] = []
        dead = bytearray(n + 1)
        at, size, before = 0, n, None
        while at < n:
            if suffix and size == n - at:  # only the last letter carries the suffix
                token = word[at:] + suffix
                if token in self.closing and (before is None or known.get((before, token)) or self.compatible(before, token)):
                    out.append(token)
                    break
                size -= 1
            size = min(size, self.longest)
            while size:
                token = word[at:at + size]
                if token in inner and not dead[at + size] and (
                        before is None or known.get((before, token)) or self.compatible(before, token)):
                    out.append(token)
                    sizes.append(size)
                    at, before = at + size, token
                    size = n - at
                    break
                size -= 1
            else:
                if not out:
                    raise ValueError("the vocabulary does not cover every byte")
                dead[at] = 1
                out.pop()
                size = sizes.pop()
                at, size, before = at - size, size - 1, out[-1] if out else None
        return tuple([self.vocab[t] for t in out])

    # -- whole texts ----------------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text: NFC, lower case, then the pattern, which drops all white space."""
        if text.isascii():
            return self.ascii_pattern.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return self.pattern.findall(text)

    def word_ids(self, piece: str) -> tuple[int, ...]:
        ids = self.words.get(piece)
        if ids is None:
            if len(self.words) >= KEPT:
                self.words.clear()
            ids = self.words[piece] = self.encode_word("".join(self.letters[b] for b in piece.encode()))
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; strings of special tokens in it are those tokens; a null is empty."""
        out: list[int] = []
        at = 0
        for m in self.marks.finditer(text or "") if self.marks else ():
            for piece in self.pieces(text[at:m.start()]):
                out += self.word_ids(piece)
            out.append(self.special[m[0]])
            at = m.end()
        get, words = self.words.get, self.word_ids
        for piece in self.pieces((text or "")[at:]):
            out += get(piece) or words(piece)
        return out

    def decode(self, ids) -> bytes:
        """Names of the tokens joined by one space, taken from the offset table."""
        ids = np.array(ids, np.int64)
        if not len(ids):
            return b""
        size = self.size[ids]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.start[ids] - first, size)
        return self.table[at][:-1].tobytes()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def coder(spark, path: str, digest: bool = False):
    """A column function of texts: struct of n_tokens, ids and the text decoded from them.

    With ``digest``, ids_sha256 and decoded_sha256 (of decimal ids joined by one space, and of the
    decoded text) stand for the last two.  A null text is empty: no ids and an empty decoded text.
    The vocabulary file is read once by the driver and broadcast; its size is the tokenizer's.
    One pass, no shuffle; rows and all other columns stay as they are.
    """
    with open(path, encoding="utf-8") as file:
        text = file.read()
    config = spark.sparkContext.broadcast((text, Encoder(json.loads(text)).never))
    kind = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"

    @F.pandas_udf(f"n_tokens long, {kind}")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        text, never = config.value
        own = Encoder(json.loads(text), never)  # one for the task, gone with it
        for texts in batches:
            rows = []
            for text in texts:
                ids = own.encode(text)
                decoded = own.decode(ids)
                rows.append((len(ids), hashlib.sha256(" ".join(map(own.digits.__getitem__, ids)).encode()).hexdigest(),
                             hashlib.sha256(decoded).hexdigest()) if digest else (len(ids), ids, decoded.decode()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in f"n_tokens long, {kind}".split(", ")])

    return encoded


@register("op10_bpe")
def op10_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", coder(spark, tokenizer_path(), digest=True)("text").alias("e")).select("doc_id", "e.*")
