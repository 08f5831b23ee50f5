"""Quality rules: word statistics of each text and a learned decision list over them, as Spark expressions only.

Sequential covering learns the list from labelled rows: each rule is a conjunction
of thresholds, grown one condition at a time by FOIL gain on two thirds of the
rows, pruned on the other third, and kept while it is right often enough there;
what it covers goes, and the next one is learned. The list is put out as one
ordered conditional expression over the statistics.

Learning takes at most ``most_rows`` labelled rows, those of least hash of the id;
the statistics cover every whole text.

Defined results: null and empty texts have no words and fail the base rules; rows
that are equal are judged alike; several labels of an id count as their least, and the least of its texts is learned from; no
labels, or of one class only, give an empty list, which keeps; extra columns don't
matter; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorix.llm.common import table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
ROWS = 8000

def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the statistics of each text, of whole texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), text.alias("t"))
    base = base.select(id_col, "t", F.array_remove(F.split(F.translate("t", SPACES, " " * len(SPACES)), " "), "").alias("w"))
    base = base.withColumn("n", F.size("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    # A window of eight words, as the hash of its words' hashes.
    spans = F.when(F.col("n") >= WINDOW, F.transform(F.slice("h", F.lit(1), F.greatest(F.col("n") - WINDOW + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("spans", spans)
    # Only texts that repeat a window look for the places.
    repeats = F.size("spans") > F.size(F.array_distinct("spans"))
    base = base.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("spans", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    twice = F.filter(F.transform("sorted", lambda x, i: F.when(((i > 0) & (F.get("sorted", i - 1)["g"] == x["g"])) | (F.coalesce(F.get("sorted", i + 1)["g"] == x["g"], F.lit(False))), x["i"])), lambda x: x.isNotNull())
    base = base.withColumn("starts", F.when(F.col("sorted").isNotNull(), F.sort_array(twice)))
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return base.select(
        id_col,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        count_of(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        count_of(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        count_of(F.col("t"), "!?").cast("long").alias("n_marks"),
        count_of(F.col("t"), "0123456789").cast("long").alias("n_digits"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
    ).withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")


def features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "capitals_share": F.col("n_capitals") / chars,
        "marks_per_word": F.col("n_marks") / words,
        "word_length": F.col("word_chars") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "digit_share": F.col("n_digits") / chars,
        "distinct_share": F.col("n_distinct") / words,
        "n_words": F.col("n_words").cast("double"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


Row = tuple[dict[str, float], int]


def _thresholds(rows: list[Row], name: str, most: int = 24) -> list[float]:
    values = sorted({r[0][name] for r in rows})
    mids = [(a + b) / 2 for a, b in zip(values, values[1:])]
    return mids if len(mids) <= most else [mids[i * len(mids) // most] for i in range(most)]


def grow(rows: list[Row], names: list[str], most: int = 3) -> list[Condition]:
    """A conjunction for class 0, one condition at a time by FOIL gain."""
    rule: list[Condition] = []
    while len(rule) < most and (p := sum(1 for r in rows if not r[1])) and p < len(rows):
        n, best = len(rows), (0.0, None, None)
        for name in names:
            ordered = sorted(rows, key=lambda r: r[0][name])
            cuts, at, below = _thresholds(rows, name), 0, 0
            for t in cuts:
                while at < n and ordered[at][0][name] <= t:
                    below += 1 - ordered[at][1]
                    at += 1
                for above, good, size in ((False, below, at), (True, p - below, n - at)):
                    if good:
                        gain = good * (log2(good / size) - log2(p / n))
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(name, above, t), None)
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if best[1].holds(r[0])]
    return rule


def covers(rule: list[Condition], row: Row) -> bool:
    return all(c.holds(row[0]) for c in rule)


def worth(rule: list[Condition], rows: list[Row]) -> float:
    hit = [r for r in rows if covers(rule, r)]
    bad = sum(1 - r[1] for r in hit)
    return (2 * bad - len(hit)) / len(hit) if hit else -1.0


def learn(rows: list[Row], names: list[str], least: float = 0.9, most_rules: int = 12) -> list[list[Condition]]:
    """Ordered rules for class 0 (reject), by sequential covering; the default is to keep."""
    rules: list[list[Condition]] = []
    grown, pruned = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    while len(rules) < most_rules and any(not r[1] for r in grown):
        rule = grow(grown, names)
        if not rule:
            break
        while len(rule) > 1:
            cut = max((rule[:i] + rule[i + 1 :] for i in range(len(rule))), key=lambda x: worth(x, pruned))
            if worth(cut, pruned) < worth(rule, pruned):
                break
            rule = cut
        seen = [r for r in grown + pruned if covers(rule, r)]
        bad = sum(1 - r[1] for r in seen)
        if (bad + 0.5) / (len(seen) + 1) < least or bad < 3:
            break
        rules.append(rule)
        grown, pruned = [r for r in grown if not covers(rule, r)], [r for r in pruned if not covers(rule, r)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_rows: int = ROWS) -> list[list[Condition]]:
    """Rules from at most ``most_rows`` rows of docs (doc_id, text) that labels (doc_id, label_col) mark 0 or 1."""
    marked = labels.groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y")).where("y is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # One text for each id, so no more rows than labels come to the driver.
    one = docs.select("doc_id", "text").join(F.broadcast(marked.select("doc_id", F.col("y").alias("_y"))), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_y").alias("_y"))
    found = statistics(one.select(F.struct("doc_id", "_y").alias("doc_id"), "text"))
    names = list(features())
    # A filter on these columns would be pushed below the array steps and be evaluated for each element: rows are few, so it waits.
    got = found.select(base_failed().alias("failed"), F.col("doc_id.doc_id").alias("id"), F.col("doc_id._y").alias("y"), *[c.cast("double").alias(k) for k, c in features().items()]).collect()
    got = sorted((r for r in got if not r["failed"]), key=lambda r: (str(r["id"]), *[r[k] for k in names]))
    return learn([({k: r[k] for k in names}, r["y"]) for r in got], names)


def verdict(rules: list[list[Condition]]) -> Column:
    """kept: the first rule that fires rejects; else the row is kept."""
    out = None
    for rule in rules:
        fires = rule[0].column()
        for c in rule[1:]:
            fires = fires & c.column()
        out = F.when(fires, F.lit(False)) if out is None else out.when(fires, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = statistics(docs, id_col, text_col).withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(docs, fit(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op2_quality": op2_quality}
