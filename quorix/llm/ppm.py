"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to order K with the counts of what follows
them; a shorter context counts a byte once for each context that extends it there
(a byte that the longer one knows isn't counted again). A byte seen in the longest context has its discounted share there; the rest
of the mass escapes to the next shorter context, with the symbols of the longer
one excluded, down to a uniform choice of the bytes never seen. A text ends with
an end symbol, and starts after K start symbols.

Pretrained: every context of the training texts stays in the trie, so it grows with
the corpus and no part of it has to fit in one memory. The cost of a byte depends on
the K bytes before it only, so the trie is held as the distinct (K + 1)-grams with
their counts, nearest context byte first: the contexts of a gram are then its
prefixes, and all that is below a context of ``root`` bytes lies together. Grams are
dealt out by their first ``root`` bytes and sorted; each task computes the cost of
each gram there from counts, totals and excluded masses of its own contexts, and of
the few shorter ones, which have a bound and go to all tasks. A text's code length is
the sum of its grams' costs: the ``HELD_GRAMS`` most frequent grams go to the
executors, the others meet their costs in a join, so no context is left out.
Adaptive: a trie that learns from the text itself as it goes.

Base: log10 of add-0.1 unigram probabilities of words. Words that are 2**-20 of all
or more go to the executors; the rest meet their counts in a join by 64-bit word
hash.

Defined results: null and empty texts have the end symbol (and the end token) only;
nothing to learn from gives the uniform model; null ids are not learned from and
not held out; repeated rows are learned from and scored each; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorix import ship
from quorix.llm.common import CHUNK, LOWER_TABLE, chunks, drop, id_mod, mix, stored, table, texts_of, word_hashes, words_of

ORDER = 6
WORD_SHARE = 20
END = 0xFF  # in no UTF-8 text
DISCOUNT = 0.3
#: Distinct keys that a task holds before it puts them out.
HELD = 800_000
#: Grams whose costs go to all executors: 32 MB.
HELD_GRAMS = 2_000_000
#: Grams of three bytes that may go to all tasks, 64 MB; beyond, those of two bytes do.
LOW_GRAMS = 4_000_000
#: Grams that a task prices at once, besides those of one root.
PRICED = 500_000


def stream_of(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts with ``order`` end symbols before, between and after them; where each text starts and where it has ended."""
    n = np.diff(offsets)
    out = np.full(len(data) + order * (len(n) + 1), END, np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(data)) + order * (row + 1)] = LOWER_TABLE[data]
    start = offsets[:-1] + order * (np.arange(len(n)) + 1)
    return out, start, start + n + 1


def keys_of(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-gram that ends at each byte of each text and at its end, as one integer, and the text of each.

    The nearest context byte comes first, the farthest next to last, and last the byte itself.
    """
    s, start, stop = stream_of(data, offsets, order)
    n = len(s) - order
    key = s[order - 1 : order - 1 + n].astype(np.uint64) if order else np.zeros(n, np.uint64)
    for i in range(2, order + 1):
        key = (key << np.uint64(8)) | s[order - i : order - i + n]
    if order:
        key <<= np.uint64(8)
    key |= s[order:]
    inside = np.zeros(len(s) + 1, np.int32)
    inside[start] += 1
    inside[stop] -= 1
    good = np.cumsum(inside[:-1])[order:] > 0
    return key[good], np.repeat(np.arange(len(start)), stop - start)


def grams_of(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (order + 1)-grams with their counts."""
    return np.unique(keys_of(data, offsets, order)[0], return_counts=True)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(c[order], first)


def corpus_counts(docs: DataFrame, text_col: str = "text", order: int = ORDER, learn: Column | None = None) -> DataFrame:
    """(kind, key, n) over all texts: 0 words by hash, 1 grams, 2 texts, as a table in the shared folder.

    Rows where ``learn`` isn't true only bring their grams along, counted 0, so that they have costs too.
    """
    ship(docs.sparkSession)
    def run(batches):
        held = {0: ([], []), 1: ([], [])}
        texts = 0

        def out(kind):
            k, c = merged(*held[kind])
            held[kind] = ([], [])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(c)], ["kind", "key", "n"])

        for batch in chunks(parted(batches), most=CHUNK // 2):
            taught = int(batch.column(1)[0].as_py())
            data, offsets = texts_of(batch)
            lower = LOWER_TABLE[data]
            starts, ends, _ = words_of(lower, offsets)
            for kind, (k, c) in ((0, np.unique(word_hashes(lower, starts, ends), return_counts=True)), (1, grams_of(data, offsets, order))):
                if kind == 0 and not taught:
                    continue
                held[kind][0].append(k)
                held[kind][1].append(c * taught)
                if sum(map(len, held[kind][0])) > HELD:
                    k, c = merged(*held[kind])
                    held[kind] = ([k], [c])
                    if 4 * len(k) > 3 * HELD:
                        yield out(kind)
            texts += taught * batch.num_rows
        for kind in (0, 1):
            if held[kind][0]:
                yield out(kind)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], ["kind", "key", "n"])

    taught = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    found = docs.select(F.col(text_col).alias("text"), taught.alias("learn")).mapInArrow(run, "kind int, key long, n long")
    return stored(found.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppmcounts")


def parted(batches):
    """Batches of which each has one value in its second column."""
    for batch in batches:
        flag = batch.column(1)
        for value in (True, False):
            part = batch.filter(flag if value else pc.invert(flag))
            if part.num_rows:
                yield part


@dataclass
class Level:
    """The counts of one order: (context, byte) nodes, and of each context the total, the number of bytes and where its nodes start."""

    node: np.ndarray
    count: np.ndarray
    context: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, node: np.ndarray, count: np.ndarray) -> Level:
        """node: sorted and distinct."""
        context = node >> np.uint64(8)
        start = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(node) else np.zeros(0, np.int64)
        total = np.add.reduceat(count, start) if len(node) else np.zeros(0, np.int64)
        return cls(node, count, context[start], total, np.diff(np.append(start, len(node))), start)

    def suffixes(self) -> np.ndarray:
        """The node of the next shorter context that each node extends."""
        return ((self.node >> np.uint64(16)) << np.uint64(8)) | (self.node & np.uint64(0xFF))

    def shorter(self) -> Level:
        """The level of the order below, if all that extends its nodes is here: a node counts once for each context that extends it."""
        return Level.of(*np.unique(self.suffixes(), return_counts=True))


def place(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each x stands, -1 if it doesn't."""
    if not len(sorted_):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def costs_of(key: np.ndarray, n: np.ndarray, low: list[Level], order: int, discount: float = DISCOUNT) -> np.ndarray:
    """log10 probability of the last byte of each gram after the others.

    key: distinct, sorted, with all grams of a context of len(low) bytes that it has any of; low: the levels of shorter contexts.
    """
    byte, learned = key & np.uint64(0xFF), n > 0
    levels = [Level.of(key[learned], n[learned])]
    while len(levels) + len(low) <= order:
        levels.insert(0, levels[0].shorter())
    levels = [*low, *levels]
    # What the bytes that follow a context weigh in the next shorter one, where they are excluded.
    excluded = [np.zeros(0, np.int64)]
    for below, level in zip(levels, levels[1:]):
        at = place(below.node, level.suffixes())
        excluded.append(np.add.reduceat(below.count[at], level.start) if len(level.start) else np.zeros(0, np.int64))
    out, left = np.zeros(len(key)), np.arange(len(key))
    longer = np.full(len(key), -1)
    for j in range(order, -1, -1):
        level = levels[j]
        context = key[left] >> np.uint64(8 * (order + 1 - j)) if j else np.zeros(len(left), np.uint64)
        here = place(level.context, context)
        node = place(level.node, (context << np.uint64(8)) | byte[left])
        known = here >= 0
        mass, kinds = np.where(known, level.total[here] if len(level.total) else 0, 0), np.where(known, level.kinds[here] if len(level.kinds) else 0, 0)
        up = longer >= 0
        if up.any():
            mass, kinds = mass - np.where(up, excluded[j + 1][longer], 0), kinds - np.where(up, levels[j + 1].kinds[longer], 0)
        any_, hit = kinds > 0, node >= 0
        found = np.flatnonzero(hit)
        out[left[found]] += np.log10((level.count[node[found]] - discount) / mass[found])
        escape = np.flatnonzero(~hit & any_)
        out[left[escape]] += np.log10(discount * kinds[escape] / mass[escape])
        left, longer = left[~hit], here[~hit]
    seen = len(levels[0].node)
    out[left] -= np.log10(max(1, 256 - seen))
    return out


def gram_costs(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n, cost) of all grams, as a table in the shared folder."""
    grams = counts.where("kind = 1").select("key", "n")

    def node(j: int) -> Column:
        context = F.shiftleft(F.shiftright("key", 8 * (order + 1 - j)), 8) if j else F.lit(0).cast("long")
        return context.bitwiseOR(F.col("key").bitwiseAND(F.lit(0xFF)))

    def nodes(j: int) -> DataFrame:
        longer = grams.where("n > 0").select(node(j).alias("node"), node(j + 1).alias("longer")).distinct()
        return longer.groupBy("node").agg(F.count("*").alias("n"))

    top = min(2, order - 1)
    if top >= 0:
        most = stored(nodes(top), "ppmlow")
        if top == 2 and most.count() > LOW_GRAMS:
            drop(most)
            top, most = 1, stored(nodes(1), "ppmlow")
        rows = most.toArrow()
        found, n = rows.column("node").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        by = np.argsort(found)
        low = [Level.of(found[by], n[by])]
        while len(low) <= top:
            low.insert(0, low[0].shorter())
        drop(most)
    else:
        low = []
    held = counts.sparkSession.sparkContext.broadcast(low)
    root = len(low)

    def run(batches):
        keys, sums, rows = [], [], 0

        def out(key, n):
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(costs_of(key, n, held.value, order))], ["key", "n", "cost"])

        for batch in batches:
            keys.append(batch.column(0).to_numpy().view(np.uint64))
            sums.append(batch.column(1).to_numpy())
            rows += batch.num_rows
            if rows >= PRICED:
                key, n = np.concatenate(keys), np.concatenate(sums)
                head = key >> np.uint64(8 * (order + 1 - root))
                stop = int(np.searchsorted(head, head[-1]))
                if stop:
                    yield out(key[:stop], n[:stop])
                keys, sums, rows = [key[stop:]], [n[stop:]], len(key) - stop
        if rows:
            yield out(np.concatenate(keys), np.concatenate(sums))

    spread = grams.repartition(F.shiftright("key", 8 * (order + 1 - root))).sortWithinPartitions("key")
    return stored(spread.mapInArrow(run, "key long, n long, cost double"), "ppmcosts")


def frequent(costs: DataFrame, most: int = HELD_GRAMS) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count of the most frequent grams, as many as fit, and their keys in order with their costs."""
    sizes = {r["b"]: r["n"] for r in costs.where("n > 0").groupBy(F.floor(F.log2(F.col("n").cast("double")) * 4).alias("b")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, None
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    if least is None:
        return 1 << 62, np.zeros(0, np.uint64), np.zeros(0)
    cut = int(np.ceil(2 ** (least / 4) - 1e-9))
    rows = costs.where(F.col("n") >= cut).select("key", "cost").toArrow()
    key, cost = rows.column("key").to_numpy().view(np.uint64), rows.column("cost").to_numpy()
    by = np.argsort(key)
    return cut, key[by], cost[by]


@dataclass
class Base:
    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    total: int
    distinct: int
    ends: int

    def log(self, c):
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def base_of(counts: DataFrame, share: int = WORD_SHARE) -> Base:
    words = counts.where("kind = 0")
    got = words.agg(F.sum("n"), F.count("*")).first()
    ends = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    total = (got[0] or 0) + ends
    rows = words.where(F.col("n") * 2.0**share >= total).select("key", "n").toArrow()
    key, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(key)
    return Base(key[order], n[order].astype(np.int64), total, got[1] + (ends > 0), ends)


def score(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, all_counted: bool = False) -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score for each row of docs, under what counts has.

    all_counted: each gram of docs is in counts, with n = 0 if it isn't learned from.
    """
    spark = docs.sparkSession
    base = base_of(counts)
    if not all_counted:
        more = corpus_counts(docs, text_col, order, F.lit(False)).where("kind = 1")
        counts = counts.unionByName(more).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    costs = gram_costs(counts, order)
    cut, keys, prices = frequent(costs)
    held = spark.sparkContext.broadcast((keys, prices, base))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        keys, prices, base = held.value
        task, done = TaskContext.get().partitionId() << 36, 0
        for batch in chunks(batches, most=CHUNK // 2):
            data, offsets = texts_of(batch)
            n = batch.num_rows
            lower = LOWER_TABLE[data]
            starts, ends, row = words_of(lower, offsets)
            words, inverse = np.unique(word_hashes(lower, starts, ends), return_inverse=True)
            at = place(base.words, words)
            gain = np.zeros(len(words))
            gain[at >= 0] = base.log(base.counts[at[at >= 0]])
            known = (at >= 0)[inverse]
            end = int(base.ends > 0)
            tokens = np.bincount(row, minlength=n) + 1
            sums = np.bincount(row, gain[inverse], n) + base.log(base.ends)
            gram, of = keys_of(data, offsets, order)
            gram, which = np.unique(gram, return_inverse=True)
            at = place(keys, gram)
            price = np.zeros(len(gram))
            price[at >= 0] = prices[at[at >= 0]]
            model = np.bincount(of, price[which], n)
            # Grams without a price here are looked up once for each text.
            missing = np.flatnonzero((at < 0)[which])
            pair, often = np.unique(of[missing] * len(gram) + which[missing], return_counts=True)
            owner, pair = np.divmod(pair, max(1, len(gram)))
            key = task + done + np.arange(n)
            done += n
            # A header for each text, then each word and gram whose count or cost is looked up in the join.
            rare = np.flatnonzero(~known)
            more = len(rare) + len(pair)
            pad = lambda x, kind=np.int64: pa.array(np.append(x, np.zeros(more)).astype(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key, key[row[rare]], key[owner]])), pa.concat_arrays([batch.column(0), pa.nulls(more, batch.column(0).type)]),
                 pa.array(np.concatenate([mix(key), words[inverse[rare]], gram[pair]]).view(np.int64)), pa.array(np.repeat(np.arange(3, dtype=np.int32), [n, len(rare), len(pair)])),
                 pa.array(np.concatenate([np.zeros(n + len(rare), np.int64), often])), pad(tokens), pad(np.bincount(row[known], minlength=n) + end), pad(sums, np.float64), pad(model, np.float64)],
                ["rk", "id", "h", "rare", "m", "n_tokens", "n_known", "base", "score"],
            )

    found = rows.mapInArrow(run, f"rk long, id {kind}, h long, rare int, m long, n_tokens long, n_known long, base double, score double")
    words = counts.where("kind = 0").select(F.lit(1).alias("wr"), F.col("key").alias("wh"), F.col("n").alias("wc"), F.lit(0.0).alias("cost"))
    grams = costs.where(F.col("n") < cut).select(F.lit(2).alias("wr"), F.col("key").alias("wh"), F.lit(0).cast("long").alias("wc"), "cost")
    both = found.join(words.unionByName(grams).hint("merge"), (F.col("h") == F.col("wh")) & (F.col("rare") == F.col("wr")), "left")
    floor = base.total + 0.1 * (base.distinct + 1)
    of_word = F.when(F.col("rare") == 1, F.log10((F.coalesce("wc", F.lit(0)) + 0.1) / floor)).otherwise(0.0)
    of_gram = F.when(F.col("rare") == 2, F.col("m") * F.coalesce("cost", F.raise_error(F.lit("a gram without a cost")).cast("double"))).otherwise(0.0)
    out = both.groupBy("rk").agg(
        F.max("id").alias(id_col), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when((F.col("rare") == 1) & (F.col("wc") > 0), 1).otherwise(0)).alias("n_known"),
        F.lit(base.total).cast("long").alias("train_tokens"), F.sum(F.col("base") + of_word).alias("base_score"), F.sum(F.col("score") + of_gram).alias("score"),
    )
    return out.drop("rk")


class Adaptive:
    """The same model as it learns from a text, byte by byte: code lengths need no training."""

    def __init__(self, order: int = ORDER, discount: float = DISCOUNT):
        self.order, self.discount = order, discount
        self.counts: dict[bytes, dict[int, int]] = {}

    def log_probability(self, context: bytes, byte: int) -> float:
        excluded: set[int] = set()
        total = 0.0
        for j in range(min(self.order, len(context)), -1, -1):
            found = self.counts.get(context[len(context) - j :])
            left = {b: c for b, c in found.items() if b not in excluded} if found else {}
            if not left:
                continue
            mass = sum(left.values())
            if byte in left:
                return total + log10((left[byte] - self.discount) / mass)
            total += log10(self.discount * len(left) / mass)
            excluded |= left.keys()
        return total - log10(256 - len(excluded))

    def learn(self, context: bytes, byte: int) -> None:
        for j in range(min(self.order, len(context)), -1, -1):
            found = self.counts.setdefault(context[len(context) - j :], {})
            found[byte] = found.get(byte, 0) + 1
            if found[byte] > 1:
                break

    def text(self, text: str | None, learn: bool = True) -> float:
        """log10 probability of a text and its end."""
        raw = bytes([END]) * self.order + (text or "").encode().translate(LOWER_TABLE.tobytes()) + bytes([END])
        total = 0.0
        for i in range(self.order, len(raw)):
            total += self.log_probability(raw[i - self.order : i], raw[i])
            if learn:
                self.learn(raw[i - self.order : i], raw[i])
        return total


def score_adaptive(docs: DataFrame, text_col: str = "text", order: int = ORDER, name: str = "adaptive_score") -> DataFrame:
    """docs with the log10 probability of each text under a model that starts empty and learns from that text alone."""
    ship(docs.sparkSession)
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([Adaptive(order).text(t) for t in column], pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op1_ppm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, corpus_counts(docs, learn=id_mod("doc_id", 10) != 0), all_counted=True)
    return out.select("doc_id", F.coalesce(id_mod("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_ppm": op1_ppm}
