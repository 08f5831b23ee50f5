"""Byte-level BPE encoding and decoding through a minimal acyclic transducer lexicon.

Words of the pre-tokenizer are counted over the whole corpus. Those that make up a
share of 2**-20 of it or more (at most 1,048,576 words, whatever the corpus) are
compiled into a minimal acyclic automaton with shared suffixes whose edges carry
outputs; their sum along a word is the place of the word's ids. The automaton is a
few flat arrays in one file, memory-mapped by each worker, and walks many words at
once. Any other word is merged exactly. A memo of bounded size holds what either
way gave, so repeated words of a partition are looked up once.

Special tokens of the tokenizer file are found in texts as its library finds them.

Defined results: null or empty text has no ids and decodes to empty text; repeated
rows are encoded alike; a text may be of any length, as may a word; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorix import ship
from quorix.llm.common import chunks, table, texts_of

#: The pattern of byte-level pre-tokenizers. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern's white space, as Unicode has it, where the regex module adds four control characters to it.
SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_SPACES = SPACES[:1] + "^" + SPACES[1:]
SHARE = 20
MEMO = 600_000
LONG = 48


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    token_bytes: list[bytes]
    byte_id: np.ndarray
    pair_keys: np.ndarray  # sorted: left * n + right
    pair_rank: np.ndarray
    pair_made: np.ndarray
    special: dict[str, int]

    @property
    def size(self) -> int:
        return len(self.token_bytes)

    @classmethod
    def load(cls, text: str) -> Vocabulary:
        """From the text of a tokenizer file."""
        spec = json.loads(text)
        vocab, of_char = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *special.values()]) + 1
        token_bytes = [b""] * n
        for token, i in vocab.items():
            token_bytes[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        for token, i in special.items():
            token_bytes[i] = token.encode()
        byte_id = np.array([vocab[c] for c in byte_characters()], np.int64)
        pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs.setdefault(vocab[a] * n + vocab[b], (rank, vocab[a + b]))
        keys = np.array(sorted(pairs), np.int64)
        return cls(token_bytes, byte_id, keys, np.array([pairs[k][0] for k in keys.tolist()], np.int32), np.array([pairs[k][1] for k in keys.tolist()], np.int32), special)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; pairs that don't merge, or hold a -1, rank last."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        good = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.pair_rank[at], np.iinfo(np.int32).max), self.pair_made[at]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.merge_long(w)
            else:
                by_size.setdefault(-(-len(w) // 4), []).append(k)
        for size, ks in by_size.items():
            for a in range(0, len(ks), 20_000):
                part = ks[a : a + 20_000]
                self._merge_many([words[k] for k in part], 4 * size, part, out)
        return out

    def _merge_many(self, words: list[bytes], width: int, places: list[int], out: list[bytes]) -> None:
        last = np.iinfo(np.int32).max
        n = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = np.full((len(words), width + 1), -1, np.int32)
        ids[:, :-1] = np.where(np.arange(width) < n[:, None], self.byte_id[raw], -1)
        rank, made = self.ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(words))
        column = np.arange(width)
        while True:
            at = rank[live].argmin(1)
            live, at = (x := rank[live, at] < last, live[x])[1], at[x]
            if not len(live):
                break
            # The leftmost pair of least rank becomes one token; what follows moves up.
            move = column[None] > at[:, None]
            old, r, m = ids[live], rank[live], made[live]
            old[np.arange(len(live)), at] = m[np.arange(len(live)), at]
            new = old.copy()
            new[:, :-1] = np.where(move, old[:, 1:], old[:, :-1])
            new[:, -1] = -1
            r[:, :-1], m[:, :-1] = np.where(move[:, :-1], r[:, 1:], r[:, :-1]), np.where(move[:, :-1], m[:, 1:], m[:, :-1])
            r[:, -1] = last
            row = np.arange(len(live))
            r[row, at], m[row, at] = self.ranks(new[row, at], new[row, at + 1])
            back = np.flatnonzero(at > 0)
            r[back, at[back] - 1], m[back, at[back] - 1] = self.ranks(new[back, at[back] - 1], new[back, at[back]])
            ids[live], rank[live], made[live] = new, r, m
        for k, row in zip(places, ids.astype("<u4")):
            out[k] = row.tobytes()
        left = (ids >= 0).sum(1)
        for k, size in zip(places, left.tolist()):
            out[k] = out[k][: 4 * size]

    @property
    def pairs(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.pair_keys.tolist(), zip(self.pair_rank.tolist(), self.pair_made.tolist())))
        return self._pairs

    def merge_long(self, word: bytes) -> bytes:
        """The same for one long word, in n log n."""
        ids, n, size, pairs = self.byte_id[np.frombuffer(word, np.uint8)].tolist(), len(word), self.size, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*p, i) for i in range(n - 1) if (p := pairs.get(ids[i] * size + ids[i + 1]))]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or pairs.get(ids[i] * size + ids[j], (None, None)) != (rank, made):
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if p := pairs.get(made * size + ids[after[i]]):
                    heapq.heappush(heap, (p[0], i, p[1]))
            if (b := before[i]) >= 0 and (p := pairs.get(ids[b] * size + made)):
                heapq.heappush(heap, (p[0], b, p[1]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()


class Lexicon:
    """The automaton: edges sorted by (state, byte), each with its target and output; final states; ids by place."""

    NAMES = ("key", "target", "output", "final", "start", "ids")
    TYPES = ("<i8", "<i4", "<i4", "u1", "<i8", "<u4")

    def __init__(self, arrays: tuple[np.ndarray, ...]):
        for name, x in zip(self.NAMES, arrays):
            setattr(self, name, x)

    @classmethod
    def compile(cls, words: dict[bytes, bytes]) -> Lexicon:
        """Minimal, by adding sorted words and merging equal states as soon as they are closed."""
        states: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path, before = [0], b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                s, parent = path.pop(), path[-1]
                byte = before[len(path) - 1]
                same = register.setdefault((final[s], *states[s].items()), s)
                states[parent][byte] = same

        ordered = sorted(words)
        for word in ordered:
            common = 0
            while common < min(len(word), len(before)) and word[common] == before[common]:
                common += 1
            close(common)
            for byte in word[common:]:
                states.append({})
                final.append(False)
                states[path[-1]][byte] = len(states) - 1
                path.append(len(states) - 1)
            final[path[-1]] = True
            before = word
        close(0)
        # Number the reachable states, count the words below each, and let edges carry how many words come before.
        number, order, below = {0: 0}, [], {}
        stack: list[tuple[int, bool]] = [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                below[s] = final[s] + sum(below[t] for t in states[s].values())
            elif s not in below:
                number.setdefault(s, len(number))
                order.append(s)
                below[s] = -1
                stack.append((s, True))
                stack += [(t, False) for t in states[s].values() if t not in below]
        edges = []
        for s in order:
            passed = int(final[s])
            for byte, t in sorted(states[s].items()):
                edges.append((number[s] * 256 + byte, number[t], passed))
                passed += below[t]
        edges.sort()
        ends = np.zeros(len(number), np.uint8)
        for s in order:
            ends[number[s]] = final[s]
        key, target, output = (np.array([e[i] for e in edges], np.int64) for i in range(3))
        ids = [words[w] for w in ordered]
        start = np.append(0, np.cumsum([len(x) // 4 for x in ids]))
        return cls(tuple(x.astype(t) for x, t in zip((key, target, output, ends, start, np.frombuffer(b"".join(ids), "<u4")), cls.TYPES)))

    def dump(self) -> bytes:
        arrays = [getattr(self, n) for n in self.NAMES]
        return b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)])

    @classmethod
    def map(cls, blob: bytes) -> Lexicon:
        """Memory-mapped from a file of this worker that is gone once nothing maps it."""
        fd, path = tempfile.mkstemp()
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(blob)
            with open(path, "rb") as f:
                held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(path)
        sizes, at, arrays = np.frombuffer(held, "<i8", len(cls.NAMES)), 8 * len(cls.NAMES), []
        for n, kind in zip(sizes.tolist(), cls.TYPES):
            arrays.append(np.frombuffer(held, kind, n, at))
            at += n * np.dtype(kind).itemsize
            at += -at % 8
        return cls(tuple(arrays))

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 if it isn't in the lexicon; all words walk together."""
        place = np.full(len(words), -1, np.int64)
        if not len(self.key):
            return place
        n = np.array([len(w) for w in words], np.int64)
        live = np.flatnonzero((n > 0) & (n <= LONG))
        raw = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(n) - n
        state, total = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state * 256 + raw[begin[live] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            good = self.key[at] == key
            live, at = live[good], at[good]
            state, total = self.target[at].astype(np.int64), total[good] + self.output[at]
            step += 1
            done = n[live] == step
            ended = np.flatnonzero(done & (self.final[state] == 1))
            place[live[ended]] = total[ended]
            live, state, total = live[~done], state[~done], total[~done]
        return place


@lru_cache(2)
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary.load(text)


@lru_cache(2)
def lexicon(blob: bytes) -> Lexicon:
    return Lexicon.map(blob)


_splitter = regex.compile(PATTERN.replace(r"\s", SPACES).replace(r"\S", NOT_SPACES).replace("[^" + SPACES, "[^" + SPACES[1:-1]))
#: The same for ASCII texts, in the standard library's engine, which takes less than half the time.
_ascii = re.compile(PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+").replace(r"[^\s", r"[^\t-\r ").replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]"))


def split_words(text: str) -> list[str]:
    return (_ascii if text.isascii() else _splitter).findall(text)



class Encoder:
    def __init__(self, vocab: Vocabulary, words: Lexicon):
        self.vocab, self.words = vocab, words
        self.memo: dict[str, bytes] = {}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(vocab.special, key=len, reverse=True)) or r"(?!)")

    def split(self, text: str) -> list[str]:
        """Words of the pre-tokenizer, special tokens as words of their own."""
        if not self.vocab.special or not self.special.search(text):
            return split_words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*split_words(text[at : m.start()]), m[0]]
            at = m.end()
        return out + split_words(text[at:])

    def learn(self, words: list[str]) -> None:
        if len(self.memo) + len(words) > MEMO:
            self.memo.clear()
        raw = [w.encode() for w in words]
        place = self.words.lookup(raw)
        start, ids = self.words.start, self.words.ids
        rest = np.flatnonzero(place < 0).tolist()
        for k in np.flatnonzero(place >= 0).tolist():
            p = place[k]
            self.memo[words[k]] = ids[start[p] : start[p + 1]].tobytes()
        for k, got in zip(rest, self.vocab.merge([raw[k] for k in rest])):
            self.memo[words[k]] = got
        for token, i in self.vocab.special.items():
            self.memo[token] = np.array([i], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        parts = [self.split(t) for t in texts]
        known = self.memo.keys()
        new = set().union(*parts) - known
        if new:
            if len(self.memo) + len(new) > MEMO:
                new = {w for p in parts for w in p}
            self.learn(sorted(new))
        get = self.memo.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocab.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict = {}


def encoder(spec: str, blob: bytes) -> Encoder:
    """One for each worker process and lexicon."""
    key = hash((spec, blob))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary(spec), lexicon(blob))
    return _encoders[key]


def word_counts(docs: DataFrame, text_col: str, spec: str) -> DataFrame:
    """(word, n) over the whole corpus."""
    ship(docs.sparkSession)
    def run(batches):
        counts: Counter[str] = Counter()
        split = Encoder(vocabulary(spec), Lexicon((np.zeros(0, np.int64),) * 6)).split
        for batch in chunks(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(split(text))
            if len(counts) > MEMO:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text_col: str, spec: str, share: int = SHARE) -> Lexicon:
    """Of the words that are 2**-share of all words of the corpus or more: at most 2**share of them."""
    counts = word_counts(docs, text_col, spec)
    from quorix.llm.common import drop, stored

    held = stored(counts, "bpewords")
    total = held.agg(F.sum("n")).first()[0] or 0
    frequent = [r[0].encode() for r in held.where(F.col("n") * 2.0**share >= total).select("word").collect()]
    drop(held)
    frequent = [w for w in frequent if len(w) <= LONG]
    return Lexicon.compile(dict(zip(frequent, vocabulary(spec).merge(frequent))))


def encode(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, share: int = SHARE, ids: bool = True) -> DataFrame:
    """docs with ids array<int> (where asked for), n_tokens, ids_sha256 and decoded_sha256; columns of those names are replaced."""
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    with open(tokenizer or tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    new = [*([StructField("ids", ArrayType(IntegerType()))] if ids else []), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    docs = docs.drop(*(f.name for f in new))
    blob = build_lexicon(docs, text_col, spec, share).dump()
    held = docs.sparkSession.sparkContext.broadcast((spec, blob))

    def run(batches):
        enc = encoder(*held.value)
        for batch in chunks(batches, text_col):
            column = batch.column(batch.schema.get_field_index(text_col))
            made = enc.encode([t or "" for t in column.to_pylist()])
            n = pa.array([len(x) // 4 for x in made], pa.int64())
            decoded = pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in made], pa.string())
            arrays = [n, pa.array([hashlib.sha256(x).hexdigest() for x in made], pa.string()), decoded]
            if ids:
                at = np.append(0, np.cumsum([len(x) // 4 for x in made])).astype(np.int32)
                arrays.insert(0, pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(made), "<i4"), pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *(f.name for f in new)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *new]))


def decode(rows: DataFrame, ids_col: str = "ids", name: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """rows with the text of their ids; null ids are none."""
    from pyspark.sql.types import StringType, StructField, StructType

    ship(rows.sparkSession)
    with open(tokenizer or tokenizer_path(), encoding="utf-8") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        tokens = vocabulary(held.value).token_bytes
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            text = pa.array([b"".join(tokens[i] for i in x or ()).decode("utf-8", "replace") for x in column], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())]))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op3_bpe": op3_bpe}
