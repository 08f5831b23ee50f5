"""Line dedup by winnowing over line hashes, with DataFrame expressions only.

A gram is the shortest run of lines from a line on that has ``noise`` words or
more; a window is the shortest run that has ``sure`` words or more. Of the grams
that lie in a window the least hash is a fingerprint (the last one of equals). So
any run of whole lines of ``sure`` words or more that stands in two documents has
a fingerprint in common, and nothing shorter than ``noise`` words is ever found.

Fingerprints that stand in two places are joined with their positions: their
documents are the ones that may repeat a run. Of these documents all grams are
compared, forward ones and the shortest ones that end at a line: a gram is a repeat
if it stood before, in the order of (document id, first line), in whichever
document, so a run needs no one partner and a fingerprint with many places no
pairs. From each fingerprint that stood before, the match is extended both ways
over repeated grams that meet, and the lines of the whole run are deleted. Each
deleted line has an equal one before it, so the first of them stays.
Within one document every gram counts: lines of a gram that came before are
deleted, and a fingerprint's first place in a document stands for it.

Rows go by hash of a gram to sums with partial aggregation; the join of a hot gram
has one row on its other side, so that adaptive execution splits it.

Lines are split at \\n and compared whole; words are runs of what isn't a space or
tab to carriage return. Lines without words are neither compared nor deleted.

Defined results: a null text stays null; an empty one stays as it is; rows that
are equal in id and text are one document, cut alike; null ids sort first; extra
columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorix.llm.common import drop, stored, table

WORD = r"[^ \t-\r]+"
NOISE, SURE = 25, 50


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col), F.length(text_col))


def line_table(docs: DataFrame, id_col: str, text_col: str, noise: int, sure: int) -> DataFrame:
    """(dk, id, at, h, n, picks, own): lines with words, their places, hashes and words, the fingerprints, what the document repeats of itself."""
    lines = docs.select(_key(id_col, text_col).alias("dk"), F.col(id_col).alias("id"), F.split(F.coalesce(text_col, F.lit("")), "\n", -1).alias("lines"))
    items = lines.select("dk", "id", F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"))), lambda x: x["n"] > 0).alias("items"))

    def upto(p: Column, words: int) -> Column:
        zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("len"), F.lit(42).cast("long").alias("g"))
        return F.aggregate(F.slice("items", p + 1, words), zero, lambda a, y: F.when(a["s"] >= words, a).otherwise(F.struct((a["s"] + y["n"]).alias("s"), (a["len"] + 1).alias("len"), F.xxhash64(a["g"], y["h"]).alias("g"))))

    grams = items.select("dk", "id", "items", F.transform("items", lambda x, p: upto(p, noise)).alias("grams"), F.transform("items", lambda x, p: upto(p, sure)).alias("spans"))

    def least(span: Column, p: Column) -> Column:
        inside = F.transform(F.slice("grams", p + 1, span["len"]), lambda g, j: F.struct(g["g"].alias("g"), (-(p + j)).alias("q"), ((g["s"] >= noise) & (j + g["len"] <= span["len"])).alias("fits")))
        return F.when(span["s"] >= sure, F.array_min(F.filter(inside, lambda x: x["fits"])))

    ranked = grams.select("*", F.array_sort(F.filter(F.transform("grams", lambda g, p: F.struct(g["g"].alias("g"), p.alias("p"), g["len"].alias("len"), g["s"].alias("s"))), lambda g: g["s"] >= noise)).alias("ranked"))
    again = F.filter(F.transform("ranked", lambda x, i: F.when((i > 0) & (F.get("ranked", i - 1)["g"] == x["g"]), F.struct(x["p"].alias("p"), x["len"].alias("len")))), lambda x: x.isNotNull())
    own = ranked.select("*", F.array_distinct(F.filter(F.transform("spans", least), lambda x: x.isNotNull())).alias("picks"), again.alias("again"))
    # Of a fingerprint's places in one document the first stands for all: the others repeat it there.
    own = own.withColumn("picks", F.array_sort(F.transform("picks", lambda x: F.struct(x["g"].alias("g"), (-x["q"]).alias("q")))))
    own = own.withColumn("picks", F.filter(F.transform("picks", lambda x, i: F.when((i == 0) | (F.get("picks", i - 1)["g"] != x["g"]), x)), lambda x: x.isNotNull()))
    return own.select(
        "dk", "id", F.col("items.i").alias("at"), F.col("items.h").alias("h"), F.col("items.n").alias("n"), "picks",
        F.array_distinct(F.flatten(F.transform("again", lambda r: F.transform(F.slice("items", r["p"] + 1, r["len"]), lambda y: y["i"])))).alias("own"),
    )


def grams_at(noise: int) -> Column:
    """(g, a, b): all grams of the lines (h, n), forward and backward, with first line and end."""
    items = F.arrays_zip("h", "n")

    def ways(items: Column, seed: int) -> Column:
        zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("len"), F.lit(seed).cast("long").alias("g"))
        add = lambda x, y: F.when(x["s"] >= noise, x).otherwise(F.struct((x["s"] + y["n"]).cast("int").alias("s"), (x["len"] + 1).alias("len"), F.xxhash64(x["g"], y["h"]).alias("g")))
        return F.transform(items, lambda x, p: F.struct(F.aggregate(F.slice(items, p + 1, noise), zero, add).alias("x"), p.alias("p")))

    def kept(found: Column, a, b) -> Column:
        return F.transform(F.filter(found, lambda y: y["x"]["s"] >= noise), lambda y: F.struct(y["x"]["g"].alias("g"), a(y).cast("int").alias("a"), b(y).cast("int").alias("b")))

    size = F.size("h")
    on = kept(ways(items, 42), lambda y: y["p"], lambda y: y["p"] + y["x"]["len"])
    back = kept(ways(F.reverse(items), 43), lambda y: size - y["p"] - y["x"]["len"], lambda y: size - y["p"])
    return F.concat(on, back)


def owned(places: DataFrame, start: str) -> DataFrame:
    """(fg, fdk, fat): the first place of each g of places (g, dk, id, start) that has more than one."""
    order = F.struct("id", "dk", F.col(start).alias("at"))
    both = places.groupBy("g").agg(F.min(order).alias("f"), F.max(order).alias("l")).where("f.dk <> l.dk or f.at <> l.at")
    return both.select(F.col("g").alias("fg"), F.col("f.dk").alias("fdk"), F.col("f.at").alias("fat"))


def deletions(lines: DataFrame, noise: int) -> DataFrame:
    """(dk, gone, whole): the lines to delete from each document that has any, and whether no line with words is left."""
    picks = stored(lines.select("dk", "id", F.explode("picks").alias("x")).select("dk", "id", F.col("x.g").alias("g"), F.col("x.q").alias("q")), "linefp")
    first = stored(owned(picks, "q"), "linefirst")
    matched = picks.join(first.hint("merge"), picks.g == first.fg)
    again = F.when((F.col("dk") != F.col("fdk")) | (F.col("q") != F.col("fat")), F.col("q"))
    found = matched.groupBy("dk").agg(F.sort_array(F.collect_set(again)).alias("qs")).withColumnRenamed("dk", "mdk")
    some = lines.join(found, F.col("dk") == F.col("mdk")).dropDuplicates(["dk"]).select("dk", "id", "at", "h", "n", "qs")
    some = stored(some, "linesome")
    drop(picks, first)
    grams = stored(some.select("dk", "id", F.explode(grams_at(noise)).alias("x")).select("dk", "id", "x.g", "x.a", "x.b"), "linegrams")
    owner = stored(owned(grams, "a"), "lineowner")
    repeats = grams.join(owner.hint("merge"), grams.g == owner.fg).where((F.col("dk") != F.col("fdk")) | (F.col("a") != F.col("fat")))
    spans = repeats.groupBy(F.col("dk").alias("sdk")).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    zero = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), none.alias("out"))

    def close(x: Column) -> Column:
        """The runs so far, with the open one if a matched fingerprint stands in it."""
        return F.when(F.exists("qs", lambda q: (q >= x["a"]) & (q < x["b"])), F.concat(x["out"], F.array(F.struct(x["a"].alias("a"), x["b"].alias("b"))))).otherwise(x["out"])

    def step(x: Column, y: Column) -> Column:
        meets = F.struct(x["a"].alias("a"), F.greatest(x["b"], y["b"]).alias("b"), x["out"].alias("out"))
        return F.when(y["a"] <= x["b"], meets).otherwise(F.struct(y["a"].alias("a"), y["b"].alias("b"), close(x).alias("out")))

    runs = some.join(spans, F.col("dk") == F.col("sdk")).select("dk", "at", F.aggregate("spans", zero, step, close).alias("runs"))
    gone = runs.select("dk", F.size("at").alias("n"), F.flatten(F.transform("runs", lambda r: F.slice("at", r["a"] + 1, r["b"] - r["a"]))).alias("gone")).where(F.size("gone") > 0)
    own = lines.select("dk", F.size("at").alias("n"), F.col("own").alias("gone")).where(F.size("gone") > 0)
    both = gone.unionByName(own).groupBy("dk").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))
    out = stored(both.select("dk", "gone", (F.size("gone") >= F.col("n")).alias("whole")), "linegone")
    drop(some, grams, owner)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, sure: int = SURE, counts: bool = False, drop_emptied: bool = False, length_col: str | None = None) -> DataFrame:
    """docs with later repeated runs of lines deleted from text_col.

    counts: also n_lines and n_removed, replacing columns of those names; drop_emptied:
    without the documents that lose all their lines with words; length_col: a column
    that takes the code points of each text that was cut.
    """
    lines = stored(line_table(docs, id_col, text_col, noise, sure), "lines")
    found = deletions(lines, noise)
    drop(lines)
    gone = found.select(F.col("dk").alias("_quorix_dk"), F.col("gone").alias("_quorix_gone"), F.col("whole").alias("_quorix_whole"))
    names = [c for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    out = docs.select(*names, _key(id_col, text_col).alias("_quorix_k")).join(gone.hint("merge"), F.col("_quorix_k") == F.col("_quorix_dk"), "left")
    if drop_emptied:
        out = out.where(~F.coalesce("_quorix_whole", F.lit(False)))
    out = out.withColumn("_quorix_lines", F.split(text_col, "\n", -1))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_quorix_lines") - 1), "_quorix_gone"), lambda i: F.get("_quorix_lines", i)), "\n")
    kept = F.when(F.col("_quorix_gone").isNull(), F.col(text_col)).otherwise(left).alias(text_col)
    extra = [F.coalesce(F.size("_quorix_lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_quorix_gone"), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    cut = [F.col("_quorix_gone").isNotNull().alias("_quorix_cut")] if length_col else []
    out = out.select(*[kept if c == text_col else F.col(c) for c in names], *extra, *cut)
    if length_col:
        out = out.withColumn(length_col, F.when(F.col("_quorix_cut"), F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))).drop("_quorix_cut")
    return out


def op5_linededup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", "text")


QUERIES = {"op5_linededup": op5_linededup}
