"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list bounds how far to the right the tokens of a prefix can depend on: a change at the right edge reaches left
only through merges of ever higher rank, each of which takes in the left or the whole side of the one before. The
longest such chain, in base symbols, is the list's sufficient lookahead. The transducer merges a window, emits the
tokens that end at least that far before the window's edge, and goes on from the last of them, so that its memory does
not grow with the word. Words within a window, nearly all, are merged at once and kept in a table of bounded size.

Texts go through in steps of STEP characters, cut at white space (a longer run without any is one step), and their ids are
handed on step by step. Decoding is an incremental state machine from ids over bytes to text; a file without a decoder
writes the token strings, separated by spaces.

Defined cases: a null text counts as empty and has no tokens; an empty table gives no rows; special tokens spelled out in a text are those tokens, as
the tokenizers library has it; rows are independent; columns of the input named like an output are replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .base import add_columns, table

KEPT = 400_000  # words that a worker keeps
STEP = 1 << 16  # characters that are encoded at a time
CUT = re.compile("[ \\t\\n\\r]")
ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split(), not to the tokenizer
RARE = re.compile("[^\0-\u024f]")
SPACE = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Merges:
    """A vocabulary with its merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks, self.lookahead = {}, 1
        reach: dict[str, int] = {}
        size = lambda s: len(s.removesuffix(self.suffix)) if self.suffix else len(s)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[a, b] = (rank, a + b)
            far = size(a) + max(size(b), reach.get(b, 0))
            reach[a], reach[a + b] = max(reach.get(a, 0), far), max(reach.get(a + b, 0), far)
            self.lookahead = max(self.lookahead, far)
        self.window = 2 * self.lookahead + 64
        self.symbols = byte_symbols()
        self.texts: list[str] = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.texts[i] = s
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, parts: list[str]) -> list[str]:
        """The tokens of a list of symbols: the lowest-ranked pair first, the leftmost of equals."""
        ranks = self.ranks
        if len(parts) > 32:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]))
                if r and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [best[1]]
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := ranks.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (r[0], x, parts[x], parts[y]))
        return [p for p in parts if p]

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """The ids of one word, each as soon as it is stable; at most `window` symbols are held."""
        held: list[str] = []
        vocab = self.vocab
        for s in symbols:
            held.append(s)
            if len(held) >= self.window:
                end, stable = 0, len(held) - self.lookahead
                for t in self.merge(held[:]):
                    if end + len(t) > stable:
                        break
                    end += len(t)
                    yield vocab[t]
                del held[:end]
        if held:
            held[-1] += self.suffix
            for t in self.merge(held):
                yield vocab[t]

    def word(self, word: str) -> bytes:
        """Packed ids of a pre-token."""
        if (ids := self.words.get(word)) is None:
            symbols = self.symbols
            ids = b"".join(struct.pack("<I", i) for i in self.stream(symbols[b] for b in word.encode("utf-8", "replace")))
            if len(word) <= 64:
                if len(self.words) >= KEPT:
                    self.words.clear()
                self.words[word] = ids
        return ids


#: Fixed value: the word pattern of the vocabulary file.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordEncoder:
    """Encodes text with a lower-casing vocabulary that drops white space."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.special = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")")
        self.rules = Tokenizer.from_file(path)
        self.bytes = {s: b for b, s in enumerate(self.merges.symbols)}

    def _pretokens(self, chunk: str) -> Iterator[str]:
        """Normalised words of a chunk. Scripts whose characters differ between Unicode versions go by the file's own rules."""
        if chunk.isascii() or not RARE.search(chunk):
            text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
            return (m[0] for m in WORDS.finditer(text.lower()))
        parts = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(chunk))
        return (bytes(map(self.bytes.__getitem__, w)).decode("utf-8", "replace") for w, _ in parts)

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of a run without white space."""
        ids = b"".join(map(self.merges.word, self._pretokens(chunk)))
        if len(chunk) <= 64:
            if len(self.merges.kept) >= KEPT:
                self.merges.kept.clear()
            self.merges.kept[chunk] = ids
        return ids

    def _plain(self, text: str) -> list[bytes]:
        chunks = [c for c in SPACE.split(text) if c] if ODD_SPACE.search(text) else text.split()
        get = self.merges.kept.get
        out = list(map(get, chunks))
        if None in out:
            out = [self._chunk(c) if b is None else b for c, b in zip(chunks, out, strict=True)]
        return out

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.stream(text))

    def stream(self, text: str | None, step: int = STEP) -> Iterator[bytes]:
        """The same ids in pieces, each of about `step` characters up to the next white space, as nothing reaches over it."""
        text, at = text or "", 0
        while at < len(text):
            end = at + step
            if end < len(text):
                cut = CUT.search(text, end)
                end = cut.start() if cut else len(text)
            part = text[at:end] if at or end < len(text) else text
            at = end
            if "<|" not in part:
                yield b"".join(self._plain(part))
                continue
            for i, piece in enumerate(self.special.split(part)):
                yield struct.pack("<I", self.merges.special[piece]) if i % 2 else b"".join(self._plain(piece))


class Decoder:
    """Incremental: feed() ids, get text as far as it is certain; finish() gives the rest."""

    def __init__(self, merges: Merges):
        self.m, self.first = merges, True
        if merges.byte_level:
            self.bytes = {s: b for b, s in enumerate(merges.symbols)}
            self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        texts = self.m.texts
        if not self.m.byte_level:
            s = " ".join(map(texts.__getitem__, ids))
            s, self.first = (s if self.first or not s else f" {s}"), self.first and not s
            return s
        out = []
        for i in ids:
            if texts[i] in self.m.special:
                out.append(self.utf8.decode(b"", True) + texts[i])
                self.utf8.reset()
            else:
                out.append(self.utf8.decode(bytes(self.bytes[c] for c in texts[i])))
        return "".join(out)

    def finish(self) -> str:
        return self.utf8.decode(b"", True) if self.m.byte_level else ""


@lru_cache(4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def decode(merges: Merges, packed: bytes, step: int = 1 << 16) -> Iterator[str]:
    ids, d = np.frombuffer(packed, "<u4"), Decoder(merges)
    for at in range(0, len(ids), step):
        yield d.feed(ids[at : at + step].tolist())
    yield d.finish()


def encode_column(df: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the packed ids (little-endian unsigned 32-bit) of a text column."""
    path = path or default_path()
    return add_columns(df, [text], [T.StructField(out, T.BinaryType())], lambda texts: [list(map(encoder(path).encode, texts))])


def decode_column(df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of packed ids."""
    path = path or default_path()
    return add_columns(df, [ids], [T.StructField(out, T.StringType())], lambda values: [["".join(decode(encoder(path).merges, v or b"")) for v in values]])


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: each text's ids are hashed and decoded as they come, and only digests leave the worker."""
    path = default_path()

    def run(texts):
        e, n, ids, back = encoder(path), [], [], []
        for t in texts:
            count, h, g, d = 0, hashlib.sha256(), hashlib.sha256(), Decoder(e.merges)
            for packed in e.stream(t):
                h.update(packed)
                count += len(packed) // 4
                g.update(d.feed(np.frombuffer(packed, "<u4").tolist()).encode())
            g.update(d.finish().encode())
            n.append(count)
            ids.append(h.hexdigest())
            back.append(g.hexdigest())
        return n, ids, back

    return add_columns(table(spark, sf_dir, "documents", "doc_id", "text"), ["text"], DIGESTS, run).drop("text")
