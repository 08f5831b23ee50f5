"""Benchmark decontamination: a BM25 index of the test items, searched by every training passage with block-max WAND.

The test items are indexed in shards of bounded size; each shard's index (postings
cut into blocks, each with its largest impact) goes to the executors, which pass
over the corpus once for each shard. A shard has a bound on items, characters and
words, so its block maxima are 100 MB at most. Words are lower-cased (A-Z) and lose
punctuation at their ends. An item counts as held where a share ``overlap`` of its
shingles is in a passage; then few of its words can be absent, so the passage's
score is at least the item's score against itself less its so many largest
impacts. Impacts are divided by that bound: the threshold is 1 for every item, and
retrieval loses nothing that verification would keep.

Passages are windows of twice the longest item, one item's length apart, so every
item that a text holds lies whole in some passage. All passages of a chunk are
tried at once against the sums of their words' block maxima: where no block can
reach the threshold, no pivot exists and the passage is done. The rest go through
block-max WAND with cursors, and what reaches the threshold is verified: the share of
the five-word shingles has to be ``overlap`` for the question, for the answer, and for
both together. A passage with the question and no answer, or another one, is no leak,
nor is an answer alone; an item without an answer counts by its question.

Defined results: null or empty texts and texts without words match nothing; an
item without words is never found; a repeated item is found under each id; repeated
rows are found each; an empty table on either side gives no rows. An item without
an answer column has its last sentence as the answer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quorix import ship
from quorix.llm.common import LOWER_TABLE, chunks, table, texts_of, word_hashes, words_of

_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]")] = True
#: Test items of a shard, characters of their text, and words: as many distinct ones have 100 MB of block maxima.
SHARD_ITEMS, SHARD_CHARS, SHARD_WORDS = 20_000, 32_000_000, 200_000
BLOCKS = 128


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in the row of each word, punctuation at its ends left out."""
    data = LOWER_TABLE[data]
    starts, ends, row = words_of(data, offsets)
    while len(starts):
        cut = (ends > starts) & _EDGE[data[ends - 1]]
        if not cut.any():
            break
        ends = ends - cut
    while len(starts):
        cut = (ends > starts) & _EDGE[data[np.minimum(starts, len(data) - 1)]]
        if not cut.any():
            break
        starts = starts + cut
    keep = ends > starts
    starts, ends, row = starts[keep], ends[keep], row[keep]
    n = np.bincount(row, minlength=len(offsets) - 1)
    return word_hashes(data, starts, ends), row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def shingles(words: np.ndarray, width: int) -> set[bytes]:
    """Of fewer words, the whole sequence; of none, nothing."""
    raw, step = words.tobytes(), 8 * width
    if len(raw) <= step:
        return {raw} if raw else set()
    return {raw[i : i + step] for i in range(0, len(raw) - step + 1, 8)}


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item that has no answer of its own: its last sentence."""
    body = text.rstrip()
    at = max(body.rfind(x, 0, len(body) - 1) for x in (". ", ".\n", "? ", "?\n", "\n"))
    return (body[: at + 1], body[at + 1 :]) if at > 0 else (body, "")


@dataclass
class Index:
    ids: list
    vocabulary: np.ndarray  # sorted word hashes
    block_max: np.ndarray  # term x block
    start: np.ndarray  # of each term's postings
    item: np.ndarray
    impact: np.ndarray
    block_size: int
    longest: int
    shingles: list  # of each item: question, answer, both
    bound: np.ndarray  # of each item: the threshold as a share of its own score

    @classmethod
    def build(cls, rows: list[tuple], width: int, overlap: float = 0.8, k1: float = 1.2, b: float = 0.75) -> Index:
        """rows: (id, question, answer)."""
        raw = [(q + "\n" + a).encode() for _, q, a in rows]
        offsets = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
        word, row, _ = normal_words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        asked = [q.encode() for _, q, _ in rows]
        at = np.append(0, np.cumsum([len(x) for x in asked])).astype(np.int64)
        question, q_row, _ = normal_words(np.frombuffer(b"".join(asked), np.uint8), at)
        n_words = np.bincount(row, minlength=len(rows))
        n_q = np.bincount(q_row, minlength=len(rows))
        ends, q_ends = np.cumsum(n_words), np.cumsum(n_q)
        parts = []
        for i in range(len(rows)):
            whole = word[ends[i] - n_words[i] : ends[i]]
            parts.append((shingles(question[q_ends[i] - n_q[i] : q_ends[i]], width), shingles(whole[n_q[i] :], width), shingles(whole, width)))
        vocabulary, term = np.unique(word, return_inverse=True)
        key, tf = np.unique(term * max(1, len(rows)) + row, return_counts=True)
        term, item = key // max(1, len(rows)), key % max(1, len(rows))
        df = np.bincount(term, minlength=len(vocabulary))
        idf = np.log1p((len(rows) - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n_words[item] / max(1e-9, n_words.mean() if len(rows) else 1)))
        own = np.bincount(item, impact, len(rows))
        impact = impact / own[item]
        by_item = np.argsort(item, kind="stable")
        item_at = np.append(0, np.cumsum(np.bincount(item, minlength=len(rows))))
        bound = np.ones(len(rows))
        for i in range(len(rows)):
            if n_words[i]:
                mine = np.sort(impact[by_item[item_at[i] : item_at[i + 1]]])[::-1]
                repeats = max(1, n_words[i] - width + 1) - len(parts[i][2]) + 1
                bound[i] = max(0.05, 1 - mine[: int((1 - overlap) * len(parts[i][2]) + 1e-9) * repeats].sum()) - 1e-6
        impact = impact / bound[item]
        block_size = max(1, -(-len(rows) // BLOCKS))
        block_max = np.zeros((len(vocabulary), BLOCKS), np.float32)
        np.maximum.at(block_max, (term, item // block_size), impact)
        return cls([r[0] for r in rows], vocabulary, block_max * np.float32(1.000001), np.append(0, np.cumsum(df)), item, impact, block_size, max(1, int(n_words.max()) if len(rows) else 1), parts, bound)

    def terms(self, words: np.ndarray) -> np.ndarray:
        """The term of each word, -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def search(self, terms: np.ndarray, least: float = 1.0) -> list[tuple[int, float]]:
        """(item, share of its own score) of all items that reach their thresholds for the distinct terms: block-max WAND."""
        place = [int(self.start[t]) for t in terms]
        stop = [int(self.start[t + 1]) for t in terms]
        upper = [float(self.block_max[t].max()) for t in terms]
        item, impact, size, out = self.item, self.impact, self.block_size, []
        live = [k for k in range(len(terms)) if place[k] < stop[k]]
        while live:
            live.sort(key=lambda k: item[place[k]])
            total, pivot = 0.0, -1
            for n, k in enumerate(live):
                total += upper[k]
                if total >= least:
                    pivot = n
                    break
            if pivot < 0:
                break
            doc = int(item[place[live[pivot]]])
            while pivot + 1 < len(live) and item[place[live[pivot + 1]]] == doc:
                pivot += 1
            block = doc // size
            head = live[: pivot + 1]
            if sum(float(self.block_max[terms[k], block]) for k in head) < least:
                # Nothing before the end of this block, or before the next cursor, can reach the threshold.
                target = (block + 1) * size
                if pivot + 1 < len(live):
                    target = min(target, int(item[place[live[pivot + 1]]]))
            elif item[place[live[0]]] == doc:
                score = sum(float(impact[place[k]]) for k in head)
                if score >= least:
                    out.append((doc, score * float(self.bound[doc])))
                target = doc + 1
            else:
                target = doc
            for k in head:
                if item[place[k]] < target:
                    place[k] += int(np.searchsorted(item[place[k] : stop[k]], target))
            live = [k for k in live if place[k] < stop[k]]
        return out


def passages(index: Index, data: np.ndarray, offsets: np.ndarray, least: float = 1.0):
    """(row, term set, words) of the passages that some block may bring to the threshold."""
    word, row, place = normal_words(data, offsets)
    if not len(word) or not len(index.ids):
        return
    new = np.append(True, (row[1:] != row[:-1]) | (place[1:] % index.longest == 0))
    begin = np.flatnonzero(new)
    piece = np.cumsum(new) - 1
    term = index.terms(word)
    known = np.flatnonzero(term >= 0)
    if not len(known):
        return
    pairs = np.unique(piece[known] * len(index.vocabulary) + term[known])
    owner, term_of = np.divmod(pairs, len(index.vocabulary))
    bound = np.zeros((len(begin), BLOCKS), np.float32)
    has, first = np.unique(owner, return_index=True)
    bound[has] = np.add.reduceat(index.block_max[term_of], first, axis=0)
    follows = np.append(row[begin[1:]] == row[begin[:-1]], False)
    both = bound.copy()
    both[np.flatnonzero(follows)] += bound[np.flatnonzero(follows) + 1]
    alone = np.append(True, ~follows[:-1])  # first of its row
    for p in np.flatnonzero((both.max(1) >= least) & (follows | alone)):
        last = p + 2 if follows[p] else p + 1
        a, b = begin[p], begin[last] if last < len(begin) else len(word)
        yield int(row[a]), np.unique(term[a:b][term[a:b] >= 0]), word[a:b]


def share(part: set[bytes], seen: set[bytes]) -> float:
    return len(part & seen) / len(part) if part else 1.0


def matches(index: Index, data: np.ndarray, offsets: np.ndarray, overlap: float, width: int):
    """(row, item, (overlap, score, of the question, of the answer)) of each passage and each item that it holds."""
    for row, terms, words in passages(index, data, offsets):
        seen = None
        for item, score in index.search(terms):
            seen = shingles(words, width) if seen is None else seen
            question, answer, both = (share(p, seen) if p and len(next(iter(p))) == 8 * width else share_short(p, words) for p in index.shingles[item])
            if min(both, question, answer) >= overlap:
                yield row, item, (both, score, question, answer)


def _items(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("q"), F.coalesce(F.col(answer_col), F.lit("")).alias("a") if answer_col else F.lit(None).cast("string").alias("a"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, overlap: float = 0.8, width: int = 5) -> DataFrame:
    """(id_col, item_id, score, question_overlap, answer_overlap): each row of docs with each item that it holds.

    Kept where a share ``overlap`` of the shingles of ``width`` words of question, answer and both is in one passage.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([StructField(id_col, rows.schema["id"].dataType), StructField("item_id", LongType()), *[StructField(n, DoubleType()) for n in ("score", "question_overlap", "answer_overlap")]])
    items = _items(benchmark, item_col, item_text, answer_col)
    out = None
    for shard in _shards(items):
        index = Index.build([(i, *(split_item(q) if a is None else (q, a))) for i, q, a in shard], width, overlap)
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            index: Index = held.value
            for batch in chunks(batches):
                ids = batch.column(0)
                best: dict[tuple[int, int], tuple] = {}
                for row, item, found in matches(index, *texts_of(batch), overlap, width):
                    if found[:2] > best.get((row, item), (0, 0))[:2]:
                        best[row, item] = found
                if best:
                    keys = sorted(best)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([k[0] for k in keys])), pa.array([index.ids[k[1]] for k in keys], pa.int64()), *[pa.array([float(best[k][j]) for k in keys]) for j in (1, 2, 3)]], schema.names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def share_short(part: set[bytes], words: np.ndarray) -> float:
    """For a part of fewer words than a shingle: whether it stands in the passage."""
    if not part:
        return 1.0
    raw, one = words.tobytes(), next(iter(part))
    return float(any(raw.startswith(one, i) for i in range(0, len(raw) - len(one) + 1, 8)))


def _shards(items: DataFrame):
    """Lists of test items, each of bounded size, one after the other on the driver."""
    shard, chars, words = [], 0, 0
    for r in items.orderBy("id", "q").toLocalIterator():
        n = len(r["q"].split()) + len((r["a"] or "").split())
        if shard and (len(shard) >= SHARD_ITEMS or chars >= SHARD_CHARS or words + n > SHARD_WORDS):
            yield shard
            shard, chars, words = [], 0, 0
        shard.append((r["id"], r["q"], r["a"]))
        chars, words = chars + len(r["q"]) + len(r["a"] or ""), words + n
    if shard:
        yield shard


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, overlap: float = 0.8, width: int = 5) -> DataFrame:
    """docs without the rows that hold a test item, in one pass over them for each shard of the benchmark."""
    ship(docs.sparkSession)
    schema = docs.schema
    for shard in _shards(_items(benchmark, item_col, item_text, answer_col)):
        held = docs.sparkSession.sparkContext.broadcast(Index.build([(i, *(split_item(q) if a is None else (q, a))) for i, q, a in shard], width, overlap))

        def run(batches, held=held):
            index: Index = held.value
            for batch in chunks(batches, text_col):
                keep = np.ones(batch.num_rows, bool)
                for row, item, _ in matches(index, *texts_of(batch, text_col), overlap, width):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
