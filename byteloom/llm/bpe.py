"""BPE encoding and decoding (operator 1).

Encoding is a streaming transducer with bounded lookahead. Whether a merge (u, v) takes place depends on what
stands to its right only through merges of smaller rank that take a token at the right edge of v; those in turn depend on
still smaller ranks. So the longest chain of such merges, computed once from the merge list (`sufficient_lookahead`), bounds
how many symbols after a token's start can change it. A word is read through a window of that many symbols and a
block more; tokens that far from the window's end are emitted and forgotten, so the transducer's memory is constant however
long a word is (a row's text and ids, 4 bytes each, are held). No merge spans words, so a word's end settles all its tokens: ordinary words are shorter than the window and take
one step, many side by side; the ids of words to 64 characters are kept in a bounded cache, longer ones for one block of texts.

Decoding pushes ids through an incremental machine from bytes to text (`Decoder`), which the query's digest of the decoded text takes piece by piece.

Nulls and empty texts have no ids and decode to ''. Texts of any length, repeated rows and ties need no special case.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_ODD = regex.compile(r"[\x1c-\x1f]")
_NONE = 1 << 40
_SHIFT = 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(rules: list[tuple[int, int, int]], parts: dict[int, tuple[int, int]], width: dict[int, int]) -> int:
    """Symbols from a token's start on which the token depends. rules: (left, right, merged) by rank."""
    reach: dict[int, int] = {}  # by left token: most symbols that rules so far look at beyond that token
    most = 1
    for left, right, _ in rules:
        beyond, t = 0, right
        while True:
            beyond = max(beyond, reach.get(t, 0))
            if t not in parts:
                break
            t = parts[t][1]
        span = width[left] + width[right] + beyond
        reach[left] = max(reach.get(left, 0), span - width[left])
        most = max(most, span)
    return most + 1


class _Generations(dict):
    """A cache of at most two generations of `size` entries of short words; what is asked for again survives. Long words are held for one block of texts only."""

    def __init__(self, size: int, make):
        super().__init__()
        self.size, self.make, self.old, self.long = size, make, {}, {}

    def __missing__(self, key):
        value = self.long.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                return self.make(key)
            self[key] = value
        return value

    def lacks(self, keys, age: bool = True) -> set:
        """Those of a set of keys that neither generation holds; a full cache ages first."""
        if age and len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        return keys.difference(self).difference(self.old).difference(self.long)

    def keep(self, found, longest: int = 64) -> None:
        for key, value in found:
            (self if len(key) <= longest else self.long)[key] = value


class _PairTable:
    """Ranks of pairs of ids, looked up for whole arrays: open addressing with short probes."""

    def __init__(self, rank: dict[int, int], bits: int = 20):
        self.mask, self.shift, self.mul = (1 << bits) - 1, np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
        self.keys, self.ranks, self.probes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64), 1
        keys = np.fromiter(rank, np.int64, len(rank))
        for key, at, r in zip(keys.tolist(), self._slot(keys).tolist(), rank.values()):
            n = 0
            while self.keys[at + n & self.mask] != -1:
                n += 1
            self.keys[at + n & self.mask], self.ranks[at + n & self.mask] = key, r
            self.probes = max(self.probes, n + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.mul) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << _SHIFT | right
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.ranks[at], _NONE)
        for _ in range(self.probes - 1):
            at = at + 1 & self.mask
            out = np.where(self.keys[at] == key, self.ranks[at], out)
        return out


class Bpe:
    """A merge list of the `tokenizers` library with byte-level symbols, word ends and lower case."""

    def __init__(self, path: str, cache: int = 250_000, block: int = 512):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.end] for c in alphabet]
        rules, parts = [], {}
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            rules.append((a, b, c))
            parts.setdefault(c, (a, b))
        self.rank = {}
        for r, (a, b, _) in enumerate(rules):
            self.rank.setdefault(a << _SHIFT | b, r)
        self.merged = [c for _, _, c in rules]
        width = {i: 1 for i in [*self.inner, *self.last]}
        for a, b, c in rules:
            width.setdefault(c, width[a] + width[b])
        self.width = width
        self.lookahead = sufficient_lookahead(rules, parts, width)
        self.window = self.lookahead + block
        pre = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pre).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")") if self.special else None
        self.cache = _Generations(cache, lambda x: b"".join(self.words(self.find(x))))  # of words and of what stands between white space alike
        self.table, self.merged_np = _PairTable(self.rank), np.asarray(self.merged)
        self.inner_np, self.last_np = np.asarray(self.inner), np.asarray(self.last)
        self.number = [str(i) for i in range(len(self.tokens))]
        backwards = {c: b for b, c in enumerate(alphabet)}
        self.raw = [self._raw(t, backwards) for t in self.tokens]
        self.shown = [t.encode("utf-8", "surrogatepass") for t in self.tokens]

    def _raw(self, token: str, backwards: dict[str, int]) -> bytes:
        if token in self.special:
            return token.encode()
        stop = self.end and token.endswith(self.end)
        body = token[: -len(self.end)] if stop else token
        return bytes(backwards[c] for c in body) + b" " * bool(stop)

    # -- encoding

    def _merge(self, s: list[int]) -> list[int]:
        """Merges in order of rank, the leftmost first, until none applies."""
        if len(s) > 64:
            return self._merge_many(s)
        get, merged = self.rank.get, self.merged
        p = [get(a << _SHIFT | b, _NONE) for a, b in zip(s, s[1:])]
        while p:
            m = min(p)
            if m == _NONE:
                break
            i = p.index(m)
            s[i] = merged[m]
            del s[i + 1], p[i]
            if i < len(p):
                p[i] = get(s[i] << _SHIFT | s[i + 1], _NONE)
            if i:
                p[i - 1] = get(s[i - 1] << _SHIFT | s[i], _NONE)
        return s

    def _merge_many(self, s: list[int]) -> list[int]:
        """The same with a queue of pairs by rank and place, and links from each symbol to those beside it."""
        get, merged, n = self.rank.get, self.merged, len(s)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(r, i) for i in range(n - 1) if (r := get(s[i] << _SHIFT | s[i + 1], _NONE)) != _NONE]
        heapify(queue)
        while queue:
            r, i = heappop(queue)
            j = after[i]
            if s[i] < 0 or j < 0 or get(s[i] << _SHIFT | s[j], _NONE) != r:
                continue  # one of the two has been merged since
            s[i], s[j] = merged[r], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (x := get(s[i] << _SHIFT | s[k], _NONE)) != _NONE:
                    heappush(queue, (x, i))
            h = before[i]
            if h >= 0 and (x := get(s[h] << _SHIFT | s[i], _NONE)) != _NONE:
                heappush(queue, (x, h))
        return [x for x in s if x >= 0]

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """The transducer: token ids of a word's symbols, each emitted once no later symbol can change it."""
        source, held, open_ = iter(symbols), [], True
        while open_ or held:
            while open_ and len(held) < self.window:
                x = next(source, None)
                if x is None:
                    open_ = False
                else:
                    held.append(x)
            tokens = self._merge(held.copy())
            if not open_:
                yield from tokens
                return
            at = 0
            for t in tokens:
                if at + self.lookahead > len(held):
                    break
                yield t
                at += self.width[t]
            del held[:at]

    def word(self, data: bytes) -> bytes:
        """The ids of a word's bytes as little-endian 32-bit numbers. Its end settles all tokens, so a word within one window needs no lookahead; others are streamed."""
        symbols = chain(map(self.inner.__getitem__, memoryview(data)[:-1]), (self.last[data[-1]],))
        return np.fromiter(self.stream(symbols), "<u4").tobytes()

    def words(self, words: list[str], block: int = 2048, longest: int = 48) -> list[bytes]:
        """The ids of each word. Short words, of which a window holds many, are merged side by side, a row each; long ones take the transducer one by one."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(data[i]))
        while order and len(data[order[-1]]) > longest:
            i = order.pop()
            out[i] = self.word(data[i])
        for at in range(0, len(order), block):
            rows = order[at : at + block]
            for i, x in zip(rows, self._side_by_side([data[i] for i in rows])):
                out[i] = x
        return out

    def _side_by_side(self, data: list[bytes]) -> list[bytes]:
        n = np.fromiter(map(len, data), np.int64, len(data))
        wide = int(n.max())
        s = np.full((len(data), wide + 1), -1, np.int64)
        filled = np.arange(wide + 1) < n[:, None]
        s[filled] = self.inner_np[np.frombuffer(b"".join(data), np.uint8)]
        last = np.fromiter((x[-1] for x in data), np.int64, len(data))
        s[np.arange(len(data)), n - 1] = self.last_np[last]
        p = np.full((len(data), wide + 1), _NONE, np.int64)
        pairs = filled[:, 1:]
        p[:, :-1][pairs] = self.table(s[:, :-1][pairs], s[:, 1:][pairs])
        done, who = [None] * len(data), np.arange(len(data))
        column = np.arange(wide + 1)
        while True:
            at = p.argmin(axis=1)
            best = p[np.arange(len(who)), at]
            going = best < _NONE
            if not going.all():
                stop = ~going
                for i, row, k in zip(who[stop].tolist(), s[stop].astype("<u4"), n[stop].tolist()):
                    done[i] = row[:k].tobytes()
                who, s, p, n, at, best = who[going], s[going], p[going], n[going], at[going], best[going]
                if not len(who):
                    return done
                wide = int(n.max())
                s, p, column = s[:, : wide + 1], p[:, : wide + 1], column[: wide + 1]
            rows = np.arange(len(who))
            s[rows, at] = self.merged_np[best]
            s = np.take_along_axis(s, np.minimum(column + (column > at[:, None]), wide), 1)
            p = np.take_along_axis(p, np.minimum(column + (column >= at[:, None]), wide), 1)
            n = n - 1
            right = at + 1 < n
            r, c = rows[right], at[right]
            p[r, c] = self.table(s[r, c], s[r, c + 1])
            p[rows[~right], at[~right]] = _NONE
            left = at > 0
            r, c = rows[left], at[left]
            p[r, c - 1] = self.table(s[r, c - 1], s[r, c])

    def _split(self, text: str) -> list[str]:
        """Normalised, in lower case and split at white space, which no token spans."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("\u03a3", "\u03c3")  # lower case goes by single characters: no final sigma
        text = text.lower()
        return _SPACES.split(text) if _ODD.search(text) else text.split()

    def _learn(self, chunks: set[str], more: bool = False) -> None:
        """Puts what the cache lacks into it; more: long words of the block's other texts stay."""
        if not more:
            self.cache.long = {}
        new = self.cache.lacks(chunks)
        parts = {x: self.find(x) for x in new if not x.isalpha()}
        words = list(self.cache.lacks(new.difference(parts).union(*parts.values()), age=False))
        self.cache.keep(zip(words, self.words(words)))
        get = self.cache.__getitem__
        self.cache.keep((x, b"".join(map(get, ws))) for x, ws in parts.items())

    def _plain(self, text: str, more: bool = False) -> bytes:
        chunks = self._split(text)
        self._learn(set(chunks), more)
        return b"".join(map(self.cache.__getitem__, chunks))

    def _has_special(self, text: str | None) -> bool:
        return bool(text) and any(x in text for x in self.special)

    def encode_bytes(self, text: str | None, more: bool = False) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self._has_special(text):
            return b"".join(np.asarray([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x, more) for x in self.at_special.split(text))
        return self._plain(text, more)

    def encode_all(self, texts: Iterable[str | None], block: int = 2_000_000) -> Iterator[bytes]:
        """encode_bytes of each text, in order; new words of about `block` characters of texts are merged together."""
        held, size = [], 0
        for t in texts:
            held.append((t, self._split(t) if t and not self._has_special(t) else None))
            size += len(t or "")
            if size >= block:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list) -> Iterator[bytes]:
        self._learn(set().union(*(c for _, c in held if c)))
        get = self.cache.__getitem__
        for t, chunks in held:
            yield self.encode_bytes(t, True) if chunks is None else b"".join(map(get, chunks))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()


class Decoder:
    """Incremental byte-to-text machine: holds the bytes of at most one unfinished character, and whether it has begun.

    words: the words that were encoded, a blank after each. Otherwise as the library decodes where no decoder is set: the tokens' own texts, a blank between two."""

    def __init__(self, bpe: Bpe, words: bool = True):
        self.pieces, self.between, self.begun = (bpe.raw, b"", False) if words else (bpe.shown, b" ", False)
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace" if words else "surrogatepass")

    def push(self, ids: Iterable[int]) -> str:
        found = [self.pieces[i] for i in ids]
        if not found:
            return ""
        data = self.between.join(found)
        if self.begun:
            data = self.between + data
        self.begun = True
        return self.utf8.decode(data)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


@lru_cache(maxsize=2)
def model(path: str) -> Bpe:
    """One for each Python worker."""
    return Bpe(path)


def _digests(bpe: Bpe, data: bytes, step: int = 65536) -> tuple[int, str, str]:
    """Ids, their digest, and that of the text that the incremental machine makes of them; at most `step` ids are numbers or text at a time."""
    numbers, decoded, machine = hashlib.sha256(), hashlib.sha256(), Decoder(bpe, words=False)
    for at in range(0, len(data), 4 * step):
        ids = np.frombuffer(data[at : at + 4 * step], "<u4").tolist()
        numbers.update(b" " * bool(at) + " ".join(map(bpe.number.__getitem__, ids)).encode())
        decoded.update(machine.push(ids).encode("utf-8", "surrogatepass"))
    decoded.update(machine.finish().encode())
    return len(data) // 4, numbers.hexdigest(), decoded.hexdigest()


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>), one for each row of docs."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        bpe = model(path)
        for b in batches:
            rows = [np.frombuffer(x, "<i4") for x in bpe.encode_all(x.as_py() for x in b.column(1))]
            offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.empty(0, "<i4")])))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, text) from rows (key, ids), by the incremental machine: normalised words, a blank after each."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        bpe = model(path)
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                d = Decoder(bpe)
                texts.append(d.push(ids or []) + d.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, one row for each row of docs: a single pass without a shuffle."""

    def run(batches):
        bpe = model(path)
        for b in batches:
            found = [_digests(bpe, x) for x in bpe.encode_all(x.as_py() for x in b.column(1))]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
