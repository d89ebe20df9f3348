"""Token counts by prefix dynamic programming.

A byte-level BPE splits a text into pieces by a fixed pattern and merges inside a piece only. So the count at the end of
piece k is the count at the end of piece k - 1 plus the piece's own count. Inside a piece, the encoding of every prefix
ends in exactly one token t such that the token before it and t stay apart when encoded together; so the count of a prefix
is one more than the count of the prefix without t, and one left-to-right pass gives the exact count of every prefix
without encoding any. Two places need care, since a prefix may be split otherwise than the whole: a prefix that ends in
white space ends in one piece of all of it, and a prefix that ends inside a contraction does not hold one.

``PrefixCounter.runs`` hands over the exact count of every prefix (by code points) of a text, in runs of bounded size.
Totals are the count of the longest prefix, and ``cut_chars`` the longest prefix within a budget; both come from these
counts, and no text is encoded whole. ``table`` is the runs as one array; ``prefix_within`` answers budget questions from
stored tables.

Exactness: texts are cut into CHUNK characters where an ASCII letter or digit precedes a space, which no piece spans. The
pattern is run here on chunks whose characters are all below U+0250, where every Unicode version agrees on letters, digits
and spaces; other chunks are split by the library's own splitter. Special strings count as one token each, as the library's
default has it. A vocabulary of another form than a plain byte-level BPE with this pattern, as its file says, is counted by
the library alone and has no tables.

Scale: one narrow pass without a shuffle; memory is one Arrow batch, one chunk's counts (``tables``: the table of the text
at hand), at most twice ``PIECES`` remembered pieces and ``PAIRS`` pairs of tokens. A piece is read once, with the
tokens that end at each place. Edge cases: null text has 0 bytes and 0 tokens; repeated rows are counted each; columns
other than doc_id and text pass by, whatever their names.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.words import lean_batches

LIMIT = 512
#: Pieces whose counts a worker remembers (twice so many), and pairs of tokens; bounds on memory alone.
PIECES, PAIRS = 200_000, 600_000
#: Fixed value: the pattern by which this family of vocabularies splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
_PLAIN = regex.compile("[\\x00-\\u024F]*")
_SPLIT = regex.compile(PATTERN)
_SPACES = regex.compile(r"\s\s+")
#: Characters whose counts are held at once, and of the longest piece that is remembered.
CHUNK, REMEMBERED = 1 << 18, 64
_BOUND = regex.compile("(?<=[A-Za-z0-9]) ")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """Fixed rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        added, split, model = said.get("added_tokens") or [], said.get("pre_tokenizer") or {}, said["model"]
        self.special = [t["content"] for t in added]
        #: Whether the file says what this module assumes.
        self.plain = (
            said.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True) and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and all(x in model["vocab"] for x in _byte_letters())
        )
        self.letters = dict(enumerate(_byte_letters()))
        #: Tokens by number; 0 is nothing.
        self.tokens = ["", *model["vocab"]] if self.plain else [""]
        self.begins = self._begins()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self._stops = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _begins(self) -> dict[str, tuple[tuple[int, int], ...]]:
        """For every beginning of a token: length and number of the tokens that end it, longest first."""
        own = {t: (len(t), n) for n, t in enumerate(self.tokens) if n}
        begins = {t[:k] for t in own for k in range(1, len(t) + 1)}
        return {x: tuple(own[x[k:]] for k in range(len(x)) if x[k:] in own) for x in begins}

    def _apart(self, pair: int) -> bool:
        """Whether two tokens, or a token after nothing, stay as they are when encoded together."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        want = [self.tokens[n] for n in divmod(pair, len(self.tokens)) if n]
        apart = self.pairs[pair] = [t.value for t in self.model.tokenize("".join(want))] == want
        return apart

    def _prefixes(self, piece: str) -> bytes:
        """Token counts of every prefix of a piece, as 32-bit numbers."""
        raw = piece.encode("utf-8", "surrogatepass")
        said = raw.decode("latin-1").translate(self.letters)
        begins, pairs, many, counts, last, start = self.begins.get, self.pairs.get, len(self.tokens), [0], [0], 0
        for i in range(1, len(said) + 1):
            # the longest ending of the prefix that begins a token; all tokens that end the prefix end it too
            while (ends := begins(said[start:i])) is None:
                start += 1
            for length, token in ends:
                pair = last[i - length] * many + token
                apart = pairs(pair)
                if self._apart(pair) if apart is None else apart:
                    counts.append(counts[i - length] + 1)
                    last.append(token)
                    break
        if len(raw) == len(piece):
            del counts[0]
        else:
            counts = [counts[end] for end in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)]
        if piece in _CONTRACTIONS:
            counts[:-1] = range(1, len(piece))
        return array("i", counts).tobytes()

    def _piece(self, piece: str) -> bytes:
        """``_prefixes``, remembered."""
        found = self.older.get(piece) or self._prefixes(piece)
        if len(piece) <= REMEMBERED:
            if len(self.known) >= PIECES:
                # emptied in place, as callers hold it; frequent pieces come back from the older half
                self.older = self.known.copy()
                self.known.clear()
            self.known[piece] = found
        return found

    def _split(self, text: str) -> list[str]:
        if text.isascii() or _PLAIN.fullmatch(text):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _chunk(self, text: str) -> np.ndarray:
        """Counts of every prefix of a chunk without special strings."""
        pieces, known = self._split(text), self.known
        inside = np.frombuffer(b"".join([known[p] if p in known else self._piece(p) for p in pieces]), np.int32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        totals = np.cumsum(inside[ends - 1], dtype=np.int64)
        found = inside + np.repeat(totals - inside[ends - 1], sizes)
        # a prefix that ends in white space ends in one piece of it
        for run in _SPACES.finditer(text):
            a, b = run.span()
            found[a:b] = (found[a - 1] if a else 0) + np.frombuffer(known.get(text[a:b]) or self._piece(text[a:b]), np.int32)
        # the whole chunk is split as it is
        found[-1] = totals[-1]
        return found

    def _plain_runs(self, text: str, base: int) -> Iterator[np.ndarray]:
        at = 0
        while at < len(text):
            bound = _BOUND.search(text, at + CHUNK) if len(text) - at > CHUNK else None
            end = bound.start() if bound else len(text)
            found = self._chunk(text[at:end] if at or end < len(text) else text) + base
            yield found
            at, base = end, int(found[-1])

    def runs(self, text: str) -> Iterator[np.ndarray]:
        """The exact count of every prefix, of the first character, the first two, and so on, in runs of bounded size."""
        if not self.plain:
            raise ValueError("tables need a plain byte-level BPE")
        at = base = 0
        for stop in self._stops.finditer(text) if self._stops else ():
            # until it is whole, a special string is text like any other
            yield from self._plain_runs(text[at : stop.end() - 1], base)
            for found in self._plain_runs(text[at : stop.start()], base):
                total = int(found[-1])
            base = (total if stop.start() > at else base) + 1
            yield np.array([base], np.int64)
            at = stop.end()
        yield from self._plain_runs(text[at:] if at else text, base)

    def table(self, text: str) -> np.ndarray:
        """``runs`` as one array."""
        return np.concatenate([np.zeros(0, np.int64), *self.runs(text)])

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the text, and characters of its longest prefix of at most ``budget`` tokens; -1 where a vocabulary
        without tables has more."""
        if not self.plain:
            n = len(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else 0
            return n, len(text) if n <= budget else -1
        at = total = best = 0
        for counts in self.runs(text):
            total = int(counts[-1])
            best = at + fits if (fits := within(counts, budget)) else best
            at += len(counts)
        return total, best

    def count(self, text: str) -> int:
        """The library's number of tokens."""
        return self.measure(text, 0)[0]

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens; -1 for a vocabulary without tables."""
        return self.measure(text, budget)[1]


@lru_cache(maxsize=4)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix whose tokens are at most ``budget``; counts need not ascend inside a piece."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _worker(path: str | None, limit: int, tables: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path or default_vocabulary())
        for batch in batches:
            rows, prefix = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                rows.append((len(text.encode("utf-8", "surrogatepass")), *counter.measure(text, limit)))
                if tables:
                    prefix.append(counter.table(text))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))]
            arrays, names = [batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_tokens", "cut_chars"]
            if tables:
                arrays.append(pa.array(prefix, pa.list_(pa.int64())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return count


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, tables: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, cut_chars (longest prefix within ``limit`` tokens).

    ``tables`` adds the array prefix_tokens, the count of every prefix. ``path`` is a vocabulary that every executor can open.
    """
    lean_batches(docs.sparkSession)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, n_tokens long, cut_chars long" + ", prefix_tokens array<long>" * tables
    return lean.mapInArrow(_worker(path, limit, tables), schema)


def prefix_within(counts: str, budget) -> F.Column:
    """From stored tables: characters of the longest prefix of at most ``budget`` tokens, as a Spark expression."""
    fits = F.transform(F.col(counts), lambda c, i: F.when(c <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("long")
