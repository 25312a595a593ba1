"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree hold (rank, position) of each adjacent pair of symbols, inner nodes the least of their
children, so the root is the leftmost merge of the lowest rank. Applying it changes three leaves and their logarithmic paths;
this goes on until the root holds no pair. Trees of many words are kept as rows of one array and advance together, so
numpy carries out each step for all of them.

Text becomes words as the tokenizer file says: its special strings are set apart, then NFC, lower case, its split pattern,
one byte symbol per UTF-8 byte, the last one with the word-end suffix. White space always separates, so a piece between
ASCII white space is encoded once and kept in a bounded cache of its worker. Decoding without a decoder in the file joins
the token strings with single spaces, as the tokenizers library does.

Edge cases: null and empty texts give no ids and decode to the empty text; a word of any length is encoded whole; a null
doc_id stays null; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import holding, over

#: Entries of a worker's cache. Longer words are not kept.
CACHE_WORDS, CACHE_BYTES = 250_000, 48
#: Bytes of text encoded at once.
_STEP = 2 << 20
_NONE = np.int64(1) << 40


def _byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


def _hash_tables(keys: np.ndarray, ranks: np.ndarray) -> list[tuple[np.int64, np.uint64, np.ndarray, np.ndarray]]:
    """Tables (multiplier, shift, keys, ranks) that hold each key in one of them, at its hash: what collides goes to the next, smaller one."""
    out, odd = [], 0x5851F42D4C957F2D
    while len(keys) or not out:
        bits = max(8, (16 * len(keys)).bit_length())
        at = (keys * np.int64(odd)).view(np.uint64) >> np.uint64(64 - bits)
        slot, first = np.unique(at, return_index=True)
        own, rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE)
        own[slot], rank[slot] = keys[first], ranks[first]
        out.append((np.int64(odd), np.uint64(64 - bits), own, rank))
        rest = np.ones(len(keys), bool)
        rest[first] = False
        keys, ranks = keys[rest], ranks[rest]
        odd = odd * 0x2545F4914F6CDD1D % (1 << 63) | 1
    return out


class SegmentTreeBPE:
    """A tokenizer file of byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        ranks = np.arange(len(keys))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        last = np.unique(keys[::-1], return_index=True)  # a pair given twice has its later rank
        self.tables = _hash_tables(last[0], ranks[::-1][last[1]])
        self.made = made
        self.strings = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s.encode()

    # ---- merges

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        out = None
        for odd, shift, keys, ranks in self.tables:
            at = (key * odd).view(np.uint64) >> shift
            rank = np.where(keys[at] == key, ranks[at], _NONE)
            out = rank if out is None else np.minimum(out, rank)
        return out

    def _merge(self, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbols, each with n[i] >= 2 of them, to the symbols left (concatenated) and how many each row has."""
        rows, width = sym.shape  # width: a power of 2
        bits = width.bit_length() - 1
        at = np.arange(width)
        tree = np.full((rows, 2 * width), _NONE << bits, np.int64)
        rank = self._rank(sym[:, :-1], sym[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(at[1:] < n[:, None], rank << bits | at[:-1], _NONE << bits)
        k = width // 2
        while k:
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
            k //= 2
        following, before = np.tile(at + 1, (rows, 1)).ravel(), np.tile(at - 1, (rows, 1)).ravel()
        alive = (at < n[:, None]).ravel()
        flat, tree, todo = sym.ravel(), tree.ravel(), np.arange(rows)
        none = _NONE << bits
        while True:
            root = tree[todo * 2 * width + 1]
            go = root < none
            if not go.all():
                todo, root = todo[go], root[go]
            if not len(todo):
                break
            base, leaf, size = todo * width, todo * 2 * width, n[todo]
            i = root & (width - 1)
            new = self.made[root >> bits]
            j = following[base + i]
            k = following[base + j]
            flat[base + i] = new
            alive[base + j] = False
            following[base + i] = k
            tree[leaf + width + j] = none
            on = k < size
            safe = np.where(on, k, i)
            before[base[on] + k[on]] = i[on]
            r = self._rank(new, flat[base + safe])
            tree[leaf + width + i] = np.where(on & (r < _NONE), r << bits | i, none)
            h = before[base + i]
            off = h < 0
            p = np.where(off, i, h)
            r = self._rank(flat[base + p], new)
            tree[leaf + width + p] = np.where(off, tree[leaf + width + p], np.where(r < _NONE, r << bits | p, none))
            i, j, p = i + width, j + width, p + width
            for _ in range(bits):
                i, j, p = i >> 1, j >> 1, p >> 1
                for node in (i, j, p):
                    two = leaf + 2 * node
                    tree[leaf + node] = np.minimum(tree[two], tree[two + 1])
        alive = alive.reshape(rows, width)
        return sym[alive], alive.sum(1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (UTF-8 of pre-tokens) one after another, and the offsets of the pieces."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        first = np.concatenate([[0], np.cumsum(n)])
        sym = self.inner[data]
        sym[first[1:][n > 0] - 1] = self.final[data[first[1:][n > 0] - 1]]
        count = n.copy()
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bits = np.ceil(np.log2(np.maximum(n, 2))).astype(int)
        for b in np.unique(bits[n > 1]):
            which = np.flatnonzero((bits == b) & (n > 1))
            for lo in range(0, len(which), step := max(1, (1 << 17) >> b)):
                rows = which[lo : lo + step]
                at = np.arange(1 << b)
                inside = at < n[rows][:, None]
                grid = np.where(inside, sym[np.minimum(first[rows][:, None] + at, len(sym) - 1)], 0)
                ids, left = self._merge(grid, n[rows])
                count[rows] = left
                parts.append((rows, ids, left))
        ends = np.cumsum(count)
        offsets = np.concatenate([[0], ends])
        out = np.empty(offsets[-1], np.uint32)
        one = np.flatnonzero(n == 1)
        out[offsets[one]] = sym[first[one]]
        for rows, ids, left in parts:
            inner = np.arange(len(ids)) - np.repeat(np.cumsum(left) - left, left)
            out[np.repeat(offsets[rows], left) + inner] = ids
        return out, offsets

    # ---- text

    def _split(self, word: bytes) -> list[bytes | int]:
        """Pre-tokens of a piece of text without ASCII white space, ids of special strings among them."""
        text = word.decode("utf-8", "replace")
        out: list[bytes | int] = []
        for part in self.special_at.split(text) if "<" in text and self.special_at else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if part.isascii():
                    low = part.lower()
                else:
                    part = unicodedata.normalize("NFC", part)
                    low = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
                out += [low.encode()] if low.isalpha() else [p.encode() for p in self.pattern.findall(low)]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the offsets of the words."""
        pieces: list[bytes] = []
        n, fixed = [], []
        for w in words:
            if w.isalpha():  # of ASCII letters: a pre-token as it is
                pieces.append(w.lower())
                n.append(1)
                continue
            found = self._split(w)
            n.append(len(found))
            for x in found:
                if isinstance(x, int):
                    fixed.append((len(pieces), x))
                    x = b""
                pieces.append(x)
        ids, offsets = self.encode_pieces(pieces)
        if fixed:
            at, special = map(np.array, zip(*fixed, strict=True))
            ids = np.insert(ids, offsets[at], special.astype(np.uint32))
            offsets = offsets + np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(pieces)))])
        return ids, offsets[np.concatenate([[0], np.cumsum(np.array(n, np.int64))])]

    def encode(self, text: str) -> list[int]:
        return self.encode_words(text.encode().split())[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces: what the library does where a file names no decoder; it leaves unknown ids out."""
        n, s = len(self.strings), self.strings
        return b" ".join([s[i] for i in ids if i < n and s[i]]).decode()


_COMMON = bytes([*b"abcdefghijklmnopqrstuvwxyz0123456789 \t\n\r\v\f,."])


def spread(text: bytes) -> bytes:
    """The text as the cache splits it. The files handled here lower-case, so variants share an entry; special strings keep
    their case. Where a text has only letters, digits, white space and lone commas and points, each of those is a pre-token
    of its own and is set apart."""
    if b"<|" in text:
        return text
    text = text.lower()
    odd = text.translate(None, _COMMON)
    if odd and not odd.decode("utf-8", "replace").isalpha() or b",," in text or b".." in text or b".," in text or b",." in text:
        return text
    return text.replace(b",", b" , ").replace(b".", b" . ")


@dataclass
class Encoded:
    """Some documents' ids one after another; slots: the cache's number of each of their words, those of document i from rows[i] on."""

    ids: np.ndarray
    ends: np.ndarray  # of the documents, in ids; 0 first
    slots: np.ndarray
    rows: np.ndarray


class WordCache:
    """Ids by word. A slice of texts is split into words and these are numbered by Arrow, so only distinct words are looked up, those
    not known are encoded together, and numpy gathers the ids of all words. Everything is dropped when the limit is passed."""

    def __init__(self, encode_words, limit: int = CACHE_WORDS):
        self.encode_words, self.limit = encode_words, limit
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[bytes]) -> Encoded:
        if len(self.start) > self.limit or len(self.ids) > 8 * self.limit:
            self._clear()
        try:
            col = pa.array([spread(t) for t in texts], pa.large_binary()).cast(pa.large_string())
        except pa.ArrowInvalid:  # not UTF-8
            col = pa.array([spread(t).decode("utf-8", "replace") for t in texts], pa.large_string())
        lists = pc.ascii_split_whitespace(col)
        coded = lists.flatten().dictionary_encode()
        words = pc.binary_join(pa.LargeListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().encode().split(b" ") if len(coded) else []
        slots = np.array(list(map(self.slot.get, words, itertools.repeat(-1))), np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            ids, offsets = self.encode_words(fresh)
            at = len(self.start) - 1
            slots[new] = at + np.arange(len(new))
            self.slot.update((w, i) for i, w in enumerate(fresh, at) if len(w) <= CACHE_BYTES)
            self.start = np.concatenate([self.start, len(self.ids) + offsets[1:]])
            self.ids = np.concatenate([self.ids, ids])
        own = slots[np.asarray(coded.indices)] if len(words) else slots
        n = self.start[own + 1] - self.start[own]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.start[own] - ends[:-1], n) + np.arange(ends[-1])]
        rows = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        return Encoded(ids, ends[rows], own, rows)


@functools.lru_cache(maxsize=1)
def tree_tokenizer(path: str) -> tuple[SegmentTreeBPE, WordCache]:
    bpe = SegmentTreeBPE(path)
    holding("bpe", tree_tokenizer.cache_clear)
    return bpe, WordCache(bpe.encode_words)


def texts_of(part: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [b"" if x is None else x for x in part.column(part.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def decoded(bpe: SegmentTreeBPE, cache: WordCache, got: Encoded) -> pa.Array:
    """The texts decoded from the ids: each distinct word's token strings are joined once, then the words of a document."""
    used, at = np.unique(got.slots, return_inverse=True)
    start, stop = cache.start[used].tolist(), cache.start[used + 1].tolist()
    ids, s = cache.ids, bpe.strings
    words = pa.array([b" ".join([s[i] for i in ids[a:b].tolist()]) for a, b in zip(start, stop, strict=True)], pa.large_binary())
    full = np.flatnonzero((cache.start[got.slots + 1] > cache.start[got.slots]))
    rows = np.searchsorted(full, got.rows)
    lists = pa.LargeListArray.from_arrays(pa.array(rows, pa.int64()), words.take(pa.array(at[full])))
    return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of each document."""

    def run(part: pa.RecordBatch) -> dict:
        bpe, cache = tree_tokenizer(path)
        got = cache.encode(texts_of(part))
        return {"doc_id": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(got.ends, pa.int32()), pa.array(got.ids.astype(np.int32))), "decoded": decoded(bpe, cache, got).cast(pa.string())}

    return over(docs, ["doc_id", "text"], "doc_id long, ids array<int>, decoded string", run, name="bpe")


def encode_digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them; with_ids: the ids too."""

    def run(part: pa.RecordBatch) -> dict:
        bpe, cache = tree_tokenizer(path)
        got = cache.encode(texts_of(part))
        raw, ends = memoryview(got.ids.astype("<u4").tobytes()), (4 * got.ends).tolist()
        texts = [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded(bpe, cache, got)]
        digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in itertools.pairwise(ends)]
        out = {"doc_id": part.column(0), "n_tokens": pa.array(np.diff(got.ends), pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(got.ends, pa.int32()), pa.array(got.ids.astype(np.int32)))
        return out

    return over(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, run, _STEP, name="bpe")


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
