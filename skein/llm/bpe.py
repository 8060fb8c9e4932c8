"""Byte-pair encoding and decoding with word ends, under a vocabulary file of a public tokenizer.

A word's parts lie in one contiguous array with the rank of each neighbouring pair beside it. The array is scanned for
the least rank, the leftmost of equal ones; that boundary is deleted and the two ranks beside it are refreshed, until no
pair has a rank. The words that a batch has and the process doesn't remember take these steps together, a row of a
matrix for each word. The steps are quadratic in the number of parts, so words of more than ``SHORT`` parts keep their
ranks in a heap instead; the result is the same.

Texts are prepared as the vocabulary file says: special tokens are cut out, the rest is brought to NFC, white space is
folded, letters are lowered one by one, and the pattern splits what lies between white space.

Defined results: a null text is an empty one, with no tokens. Whole texts are encoded, without truncation or padding.
Repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import bounded_batches, slices

#: Words with more parts than this keep their ranks in a heap.
SHORT = 64
#: Pieces of text that a process remembers, and the code points of text that are encoded together.
REMEMBER = 150_000
TOGETHER = 1 << 18
#: Rows of a matrix.
ROWS = 1 << 14
ENCODING = "struct<ids:binary,decoded:string>"
TOKENS = "struct<ids:array<int>,ids_sha256:string,decoded_sha256:string>"
DIGESTS = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"

TOKEN_ARRAY = pa.struct([pa.field("ids", pa.list_(pa.int32())), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())])

_loaded: dict[str, "Bpe"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: (left id, right id) -> rank, and rank -> id of the merged pair
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        self.never = len(merges)
        self.inner = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.final = np.array([vocab[c + suffix] for c in byte_letters()], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # unlike str.split(), the file's \\s leaves these four in words
        self.odd = regex.compile("[\x1c-\x1f]")
        self.space = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1)
        #: piece between white space -> its ids as bytes
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Bpe:
        """The tokenizer of a file; each process reads it once."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), self.never - 1)
        return np.where(self.keys[at] == pair, self.by_key[at], self.never)

    def _merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of at most SHORT bytes each, as bytes; the words are of similar length."""
        sizes = np.array([len(w) for w in words])
        width, row = int(sizes.max()), np.arange(len(words))
        # ids past a word's end are larger than any in the vocabulary
        ids = np.full((len(words), width), 1 << 30, np.int64)
        ids[np.arange(width) < sizes[:, None]] = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ids[row, sizes - 1] = self.final[np.array([w[-1] for w in words])]
        ranks = np.full(ids.shape, self.never, np.int64)
        ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        out, which = [b""] * len(words), row
        while len(which):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(which)), at]
            done = least == self.never
            if done.any():
                size = 4 * ids.shape[1]
                raw = ids[done].astype("<u4").tobytes()
                for k, (w, n) in enumerate(zip(which[done].tolist(), sizes[done].tolist(), strict=True)):
                    out[w] = raw[k * size : k * size + 4 * n]
                left = ~done
                which, sizes, at, least = which[left], sizes[left], at[left], least[left]
                if not len(which):
                    break
                width = int(sizes.max())
                ids, ranks = ids[left, :width], ranks[left, :width]
            row, column = np.arange(len(which)), np.arange(ids.shape[1] - 1)
            ids[row, at] = self.merged[least]
            beyond = column > at[:, None]
            ids[:, :-1] = np.where(beyond, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = 1 << 30
            ranks[:, :-1] = np.where(beyond | (column == at[:, None]), ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = self.never
            sizes = sizes - 1
            last = np.minimum(at + 1, ids.shape[1] - 1)
            ranks[row, at] = np.where(at + 1 < sizes, self._ranks(ids[row, at], ids[row, last]), self.never)
            inside = np.flatnonzero(at > 0)
            before = at[inside] - 1
            ranks[inside, before] = self._ranks(ids[inside, before], ids[inside, before + 1])
        return out

    def _merge_long(self, word: bytes) -> bytes:
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        n, get, merged = len(ids), self.rank.get, self.merged.tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(rank, at) for at in range(n - 1) if (rank := get((ids[at], ids[at + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at] if ids[at] >= 0 else -1
            if right < 0 or get((ids[at], ids[right])) != rank:
                continue
            ids[at], ids[right] = merged[rank], -1
            after[at] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = at
            for a, b in ((before[at], at), (at, beyond)):
                if a >= 0 and b >= 0 and (new := get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (new, a))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _merge(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words."""
        raw = sorted(((w.encode("utf-8", "replace"), w) for w in words), key=lambda x: len(x[0]))
        found = {w: self._merge_long(b) for b, w in raw if len(b) > SHORT}
        raw = raw[: len(raw) - len(found)]
        for k in range(0, len(raw), ROWS):
            part = raw[k : k + ROWS]
            found.update(zip([w for _, w in part], self._merge_short([b for b, _ in part]), strict=True))
        return found

    def _learn(self, pieces: set[str]) -> None:
        """Remember the ids of these pieces; of the others too, unless they are too many."""
        known = self.known
        if len(known) > REMEMBER:
            self.known = known = {p: known[p] for p in pieces & known.keys()}
        fresh = [p for p in pieces if p not in known]
        split = {p: self.words(p) for p in fresh if not p.isalpha()}
        words = {p for p in fresh if p not in split}
        words.update(w for own in split.values() for w in own if w not in known)
        known.update(self._merge([w for w in words if w]))
        known.update({p: b"".join([known[w] for w in own]) for p, own in split.items()})

    def _pieces(self, text: str) -> list[str]:
        """What lies between white space, prepared."""
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            text = "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()
        return [p for p in self.space.split(text) if p] if self.odd.search(text) else text.split()

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < TOGETHER:
                size += len(texts[end])
                end += 1
            # special tokens become lists of one id between lists of pieces
            cut = [[self._pieces(t) if k % 2 == 0 else [self.special[t]] for k, t in enumerate(self.cut.split(x) if "<|" in x else (x,))] for x in texts[at:end]]
            self._learn({p for parts in cut for own in parts[::2] for p in own})
            ids = self.known.__getitem__
            for parts in cut:
                yield b"".join([b"".join(map(ids, own)) if k % 2 == 0 else np.array(own, "<u4").tobytes() for k, own in enumerate(parts)])
            at = end

    def decode(self, ids: bytes) -> str:
        """The tokens joined by spaces, as this vocabulary has no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoding(text: Column, path: str | None = None) -> Column:
    """A struct of ids (little-endian unsigned 32-bit integers) and the text decoded from them."""
    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = Bpe.load(path or default_path())
        for column in columns:
            found = [i for part in slices(column) for i in bpe.encode_all([t or "" for t in part])]
            yield pa.StructArray.from_arrays([pa.array(found, pa.binary()), pa.array(map(bpe.decode, found), pa.string())], names=["ids", "decoded"])

    batches.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, ENCODING)(text)


def digests(text: Column, path: str | None = None) -> Column:
    """A struct of the number of tokens and SHA-256 of the ids and of the decoded text: what ``encoding`` returns, hashed
    where it is made, so that neither leaves the Python process."""
    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = Bpe.load(path or default_path())
        for column in columns:
            found = [(len(i) // 4, *_sha256(bpe, i)) for part in slices(column) for i in bpe.encode_all([t or "" for t in part])]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())],
                names=["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    batches.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, DIGESTS)(text)


def _sha256(bpe: Bpe, ids: bytes) -> tuple[str, str]:
    """SHA-256 of ids and of the text decoded from them."""
    return hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()


def _token_array(bpe: Bpe, texts: list[str | None]) -> pa.StructArray:
    found = list(bpe.encode_all([t or "" for t in texts]))
    offsets = np.cumsum([0, *(len(i) // 4 for i in found)])
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
    digests = [_sha256(bpe, i) for i in found]
    return pa.StructArray.from_arrays([ids, pa.array([d[0] for d in digests], pa.string()), pa.array([d[1] for d in digests], pa.string())], fields=list(TOKEN_ARRAY))


def tokens(text: Column, path: str | None = None) -> Column:
    """A struct of the ids as an array, and SHA-256 of the ids and of the text decoded from them."""
    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = Bpe.load(path or default_path())
        for column in columns:
            parts = [_token_array(bpe, part) for part in slices(column)]
            yield pa.concat_arrays(parts) if parts else pa.array([], TOKEN_ARRAY)

    batches.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, TOKENS)(text)


def encode_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    bounded_batches(docs)
    found = docs.select(F.col(doc_id).alias("doc_id"), digests(F.col(text), path).alias("e"))
    return found.select("doc_id", "e.n_tokens", "e.ids_sha256", "e.decoded_sha256")
