"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus' most frequent words, counted over all documents, are compiled with
their ids into an automaton that shares prefixes and suffixes; edges carry the
number of words that precede them, so that a walk sums to a word's place in the
table of ids.  The automaton is one block of bytes: broadcast once (its size is
bounded by the number of words), written to an unlinked file by each worker and
memory-mapped.  A batch's distinct words walk it together, one byte a step.
Words that it lacks are merged exactly: rows of symbol ids, of which each step
merges the leftmost pair of least rank.

Bound to byte-mapped BPE files of the tokenizers library with an end-of-word
suffix, NFC, lower case and the split pattern of such files; others are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, stored

LEXICON_WORDS = 1 << 16
#: Of one worker's table of merged words; it starts anew beyond.
CACHE_WORDS = 60_000
#: Words counted in a task before their counts are handed on.
COUNTED_WORDS = 100_000
#: Text that is cut into words at once.
PART_BYTES = 256 << 10

#: White space as the tokenizer's patterns see it, and the split pattern.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Model:
    """Ids, merges and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        m, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        steps = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if m["type"] != "BPE" or not suffix or steps[:1] != [PATTERN] or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError(f"{path} is not a lower-cased byte BPE with word ends")
        vocab: dict[str, int] = m["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        pairs = [(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in m["merges"])]
        a, b, rank, new = np.array(pairs, np.int64).T
        order = np.argsort(a << 17 | b, kind="stable")
        self.keys, self.ranks, self.made = (a << 17 | b)[order], rank[order].astype(np.int32), new[order].astype(np.int32)

    NONE = np.int32(2**31 - 1)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they don't merge) and place of pairs."""
        key = a.astype(np.int64) << 17 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], self.NONE), at

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (not empty)."""
        out: list = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for top in (4, 8, 12, 16, 24, 40, 64):
            mine = np.flatnonzero((size > low) & (size <= top))
            for part in (mine[i : i + 20_000] for i in range(0, len(mine), 20_000)):
                ids, length = self._merge_rows([words[i] for i in part], size[part], top)
                for i, row, n in zip(part.tolist(), ids, length.tolist(), strict=True):
                    out[i] = row[:n]
            low = top
        for i in np.flatnonzero(size > low).tolist():
            out[i] = self._merge_one(words[i])
        return out

    def _merge_rows(self, words: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        raw = np.zeros((len(words), width), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        rows = np.repeat(np.arange(len(words)), size)
        cols = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        raw[rows, cols] = flat
        final = np.full((len(words), width), -1, np.int32)
        length = size.copy()
        ids = np.where(np.arange(width) < (size - 1)[:, None], self.inner[raw], self.last[raw])
        ids = np.where(np.arange(width) < size[:, None], ids, -1).astype(np.int32)
        row = np.arange(len(words))
        rank, place = self.find(ids[:, :-1], ids[:, 1:])
        cols = np.arange(width)
        while len(row):
            at = rank.argmin(1)
            n = np.arange(len(row))
            open_ = rank[n, at] < self.NONE
            if not open_.all():
                final[row[~open_]] = ids[~open_]
                ids, rank, place, row, at = ids[open_], rank[open_], place[open_], row[open_], at[open_]
                n = np.arange(len(row))
                if not len(row):
                    break
            made = self.made[place[n, at]]
            length[row] -= 1
            source = cols + (cols > at[:, None])
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), source, 1)
            ids[n, at] = made
            short = source[:, : width - 1]
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=self.NONE), short, 1)
            place = np.take_along_axis(np.pad(place, ((0, 0), (0, 1))), short, 1)
            right = np.minimum(at, width - 2)
            r, p = self.find(ids[n, right], ids[n, right + 1])
            rank[n, right], place[n, right] = r, p
            left = np.maximum(at - 1, 0)
            r, p = self.find(ids[n, left], ids[n, left + 1])
            rank[n, left], place[n, left] = r, p
        return final, length

    def _merge_one(self, word: bytes) -> np.ndarray:
        """The same for a long word: a heap of pairs over a linked list."""
        ids = [*self.inner[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        table = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made, strict=True)} if not hasattr(self, "_table") else self._table
        self._table = table
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if i >= 0 and j >= 0 and (got := table.get(ids[i] << 17 | ids[j])):
                heapq.heappush(heap, (got[0], i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i] = table[a << 17 | b][1]
            ids[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        return np.array([x for x in ids if x >= 0], np.int32)


def compile_lexicon(entries: dict[bytes, np.ndarray]) -> dict[str, np.ndarray]:
    """Words and their ids as a minimal acyclic transducer, in flat arrays.

    Words are added in byte order; the part of the last word that the next doesn't
    share is replaced by equal states already registered.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, {}]]
    last = b""
    for w in words:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        for i in range(len(last), same, -1):
            path[i - 1][1][last[i - 1]] = freeze(path.pop())
        for b in w[same:]:
            path[-1][1][b] = None
            path.append([False, {}])
        path[-1][0] = True
        last = w
    for i in range(len(last), 0, -1):
        path[i - 1][1][last[i - 1]] = freeze(path.pop())
    root = freeze(path[0])
    below = np.zeros(len(states), np.int64)
    key, to, add = [], [], []
    for s, (final, edges) in enumerate(states):  # children come before parents
        n = int(final)
        for b, t in edges:
            key.append(s << 8 | b)
            to.append(t)
            add.append(n)
            n += int(below[t])
        below[s] = n
    order = np.argsort(np.array(key, np.int64))
    ids = [entries[w] for w in words]
    return {
        "root": np.array([root], np.int64), "key": np.array(key, np.int64)[order], "to": np.array(to, np.int32)[order], "add": np.array(add, np.int32)[order],
        "final": np.array([s[0] for s in states], bool), "start": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), "ids": np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32),
    }


def pack(arrays: dict[str, np.ndarray]) -> tuple[bytes, list]:
    """One block of bytes and where each array lies in it."""
    block, index = bytearray(), []
    for name, a in arrays.items():
        block += bytes(-len(block) % 8)
        index.append((name, a.dtype.str, len(block), len(a)))
        block += a.tobytes()
    return bytes(block) or bytes(8), index


class Lexicon:
    """A mapped transducer."""

    def __init__(self, block: bytes, index: list):
        with tempfile.TemporaryFile() as f:  # has no name, and its space goes with the mapping
            f.write(block)
            f.flush()
            mapped = np.memmap(f, np.uint8, "r")
        for name, kind, at, n in index:
            setattr(self, name, np.ndarray(n, np.dtype(kind), mapped, at))
        self.longest = 0 if not len(self.key) else 64

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, or -1."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state, place = np.full(n, self.root[0], np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((size > 0) & (size <= self.longest))
        found = np.full(n, -1, np.int64)
        step = 0
        while len(live):
            key = state[live] << 8 | flat[begin[live] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.to[at]
            place[live] += self.add[at]
            step += 1
            end = size[live] == step
            done = live[end]
            done = done[self.final[state[done]]]
            found[done] = place[done]
            live = live[~end]
        return found


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 any other."""
    kind = np.full(0x110000, 3, np.uint8)
    runs = [(k, regex.compile(p)) for k, p in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, f"[{SPACE}]+"))]
    for first in range(0, 0x110000, 0x800):
        if 0xD800 <= first < 0xE000:
            continue  # surrogates
        block = "".join(map(chr, range(first, first + 0x800)))
        for k, pattern in runs:
            for m in pattern.finditer(block):
                kind[first + m.start() : first + m.end()] = k
    return kind


def normal(text: str) -> str:
    if not text.isascii():
        text = (text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).replace("Σ", "σ")
    return text.lower()


class Pieces:
    """A batch's words by the split pattern: distinct words, a code for each word, bounds by document.

    Works on the code points of all texts at once.  Words are told apart by a
    128-bit hash.  Special strings are words of their own, named by themselves.
    """

    def __init__(self, texts: list[str | None], special: regex.Pattern):
        parts, marks, begins, at = [], [], [], 0
        for text in texts:
            begins.append(at)
            for i, part in enumerate(special.split(text) if text and "<" in text and special.search(text) else [text or ""]):
                if i % 2:
                    marks.append((at, part))
                    part = ""
                part = normal(part)
                parts.append(part)
                at += len(part) + 1
        whole = "\n".join(parts) + "\n" if parts else ""
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[points]
        new = np.empty(len(kind), bool)
        new[:1] = True
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        quote = np.flatnonzero((points == 39) & new)
        quote = quote[new[quote + 1] & (kind[quote + 1] == 1)]
        if len(quote):
            padded = np.concatenate([points, np.zeros(3, np.uint32)])
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            new[quote[short | long] + 1] = False
            new[np.concatenate([quote[short] + 2, quote[long] + 3])] = True
        edges = np.append(np.flatnonzero(new), len(kind))
        start, end = edges[:-1], edges[1:]
        real = kind[start] != 0
        start, end = start[real], end[real]
        hashes = [K.Prefix(K.mix(points, seed), base).of(start, end) for seed, base in ((21, K._BASE_BYTE), (22, K._BASE_WORD))]
        if marks:
            first = np.array([m[0] for m in marks])
            order = np.argsort(np.concatenate([start, first]), kind="stable")
            ids = np.array([int.from_bytes(hashlib.sha256(m[1].encode()).digest()[:8], "big") for m in marks], K.U)
            hashes = [np.concatenate([h, ids])[order] for h in hashes]
            end = np.concatenate([end, -1 - np.arange(len(marks))])[order]
            start = np.concatenate([start, first])[order]
        self.codes, keys = pd.factorize(hashes[0])
        first = np.full(len(keys), len(start))
        np.minimum.at(first, self.codes, np.arange(len(start)))
        if not (hashes[1][first[self.codes]] == hashes[1]).all():  # two words of one hash
            self.codes, keys = pd.factorize(np.array([whole[i:j] if j >= 0 else marks[-1 - j][1] for i, j in zip(start.tolist(), end.tolist(), strict=True)], object))
            self.words = list(keys)
        else:
            self.words = [whole[i:j] if j >= 0 else marks[-1 - j][1] for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        self.bounds = np.searchsorted(start, np.append(np.array(begins, np.int64), at)).tolist()


def word_counts(docs: DataFrame, special: list[str]) -> DataFrame:
    """(word, n) over all texts of docs; each task hands on sums."""
    pattern = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return b

        for batch in batches:
            for b in K.parts(batch, 0, PART_BYTES):
                p = Pieces(b.column(0).to_pylist(), pattern)
                for w, n in zip(p.words, np.bincount(p.codes, minlength=len(p.words)).tolist(), strict=True):
                    total[w] += n
                if len(total) > COUNTED_WORDS:
                    yield out()
        for c in special:
            total.pop(c, None)
        if total:
            yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(K.lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start..start+length of each pair, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class Decoder:
    """Ids to text by the table of ids: a file without a decoder joins its tokens by one space."""

    def __init__(self, model: Model):
        self.tokens = np.array(model.tokens, object)

    def texts(self, ids: np.ndarray, bounds: list[int]) -> Iterator[str]:
        """The text of each run of ids."""
        tokens = self.tokens[ids].tolist()
        for i, j in itertools.pairwise(bounds):
            yield " ".join(tokens[i:j])


class Coder:
    """A worker's encoder: a batch of texts to ids; words that it has met stay in a table of ids."""

    def __init__(self, model: Model, block: bytes, index: list):
        self.model, self.lexicon = model, Lexicon(block, index)
        self.names = np.array([str(i) for i in range(len(model.tokens))], object)
        self.special = regex.compile("(" + "|".join(map(regex.escape, model.special)) + ")") if model.special else regex.compile(r"((?!))")
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}  # of a word in the next two
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._append(list(self.model.special), [np.array([i], np.int32) for i in self.model.special.values()])

    def _append(self, words: list[str], made: list[np.ndarray]) -> None:
        size = np.fromiter(map(len, made), np.int64, len(made))
        self.place.update(zip(words, range(len(self.start), len(self.start) + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.length, self.flat = np.concatenate([self.length, size]), np.concatenate([self.flat, *made])

    def ids(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode() for w in words]
        at = self.lexicon.find(raw)
        out: list = [self.lexicon.ids[self.lexicon.start[i] : self.lexicon.start[i + 1]] if i >= 0 else None for i in at.tolist()]
        unseen = np.flatnonzero(at < 0).tolist()
        for i, x in zip(unseen, self.model.merge([raw[i] for i in unseen]), strict=True):
            out[i] = x
        return out

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts, and each text's bounds in them."""
        p = Pieces(texts, self.special)
        if len(self.place) > CACHE_WORDS:
            self.forget()
        if new := [w for w in p.words if w not in self.place]:
            self._append(new, self.ids(new))
        word = np.fromiter(map(self.place.__getitem__, p.words), np.int64, len(p.words))[p.codes]
        length = self.length[word]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.flat[spread(self.start[word], length)], ends[p.bounds].tolist()

    def written(self, ids: np.ndarray, bounds: list[int]) -> Iterator[str]:
        """Each text's ids in decimals, joined by one space."""
        names = self.names[ids].tolist()
        for i, j in itertools.pairwise(bounds):
            yield " ".join(names[i:j])


class Given:
    """What encode() broadcasts.  A worker's coder lives in its copy: Spark drops that when a task of the worker
    doesn't use the broadcast, so that no worker holds a coder beside what other stages need."""

    def __init__(self, model: Model, block: bytes, index: list):
        self.parts = (model, block, index)
        self._made: tuple[Coder, Decoder] | None = None

    def coders(self) -> tuple[Coder, Decoder]:
        if self._made is None:
            self._made = Coder(*self.parts), Decoder(self.parts[0])
        return self._made


def build_lexicon(docs: DataFrame, model: Model, size: int = LEXICON_WORDS) -> dict[str, np.ndarray]:
    """The transducer of the docs' most frequent words: at most ``size``, of at most 64 bytes each.

    Words come in classes of like counts (quarters of a power of two); the most frequent
    classes that fit as a whole are taken, so that no task and no driver sorts more.
    """
    counts = stored(word_counts(docs, list(model.special)).where(F.octet_length("word") <= 64).withColumn("class", F.floor(F.log2("n") * 4)))
    total, least = 0, None
    for r in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        total += r["count"]
        if total > size:
            break
        least = r["class"]
    words = [] if least is None else [r.word.encode() for r in counts.where(F.col("class") >= least).select("word").collect()]
    discard(counts)
    return compile_lexicon(dict(zip(words, model.merge(words), strict=True)))


def encode(docs: DataFrame, path: str, size: int = LEXICON_WORDS, texts: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for every row of docs.

    ids are the file's ids without added ones, as text, joined by one space; decoded
    is what the decoder makes of these ids.  The digests are their lower-case SHA-256.

    Defined cases: null text counts as empty, with no ids and an empty decoded text;
    a special string inside a text becomes its id; null ids and repeated rows are
    encoded like any other; other columns aren't read.
    """
    model = Model(path)
    given = docs.sparkSession.sparkContext.broadcast(Given(model, *pack(build_lexicon(docs, model, size))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, decoder = given.value.coders()
        for batch in batches:
            for b in K.parts(batch, 1, PART_BYTES):
                ids, bounds = coder.documents(b.column(1).to_pylist())
                made = [list(coder.written(ids, bounds)), list(decoder.texts(ids, bounds))]
                cols = [b.column(0), pa.array(np.diff(bounds)), *(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs], pa.string()) for xs in made)]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(x, pa.string()) for x in made] if texts else [])], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if texts else [])]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if texts else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.lean(run), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids): ids in decimals, joined by one space, as encode() gives them.

    Null or empty ids give an empty text; an id that the file lacks is an error; null
    doc_ids and repeated rows are decoded like any other; other columns aren't read.
    """
    given = encoded.sparkSession.sparkContext.broadcast(Model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(given.value)
        for batch in batches:
            for b in K.parts(batch, 1, PART_BYTES):
                each = [np.array((x or "").split(), np.int64) for x in b.column(1).to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).tolist()
                flat = np.concatenate(each)
                if (flat < 0).any():
                    raise ValueError("ids must not be negative")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(decoder.texts(flat, bounds)), pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("string").alias("ids")).mapInArrow(K.lean(run), "doc_id long, decoded string")
