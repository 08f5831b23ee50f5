"""Each operator against a brute-force version, and on odd tables."""

import base64
import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorix.llm import bpe, common, decontaminate, html, linededup, ppm, quality, registry, simhash, suffix, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").toPandas()


def random_words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x" for _ in range(n)]


# -- shared helpers ---------------------------------------------------------------------------------


def test_spans_hash_equal_strings_alike():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    h = common.Spans(data).hash(np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 340)] + [(999, i) for i in range(1000, 1050)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in root if find(n) != n}


# -- 1 ----------------------------------------------------------------------------------------------


def test_ppm_base_and_probabilities(spark, data):
    rows = texts(spark, data)
    got = ppm.op1_ppm(spark, data).orderBy("doc_id").toPandas()
    words = [[*WORD.findall(t.translate(LOWER)), None] for t in rows.text]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in rows.doc_id]
    count = collections.Counter(w for ws, h in zip(words, held) if not h for w in ws)
    total = sum(count.values())
    floor = total + 0.1 * (len(count) + 1)
    assert got.held_out.tolist() == held and (got.train_tokens == total).all()
    assert got.n_tokens.tolist() == [len(w) for w in words]
    assert got.n_known.tolist() == [sum(count[w] > 0 for w in ws) for ws in words]
    assert np.allclose(got.base_score, [sum(np.log10((count[w] + 0.1) / floor) for w in ws) for ws in words])
    assert (got.score < 0).all()


def brute(train, order=ppm.ORDER):
    trie = ppm.Adaptive(order)
    for t in train:
        trie.text(t)
    return trie


@pytest.mark.parametrize("order", [1, 6])
def test_ppm_equals_a_trie_in_memory(spark, make, monkeypatch, order):
    """Every text's score, with and without joins and with either root."""
    train = ["the cat sat on the mat", "The Cat ran", "a dog — ü", None, "", "the cat sat on the mat"]
    new = ["the cat", "zebra ☃", "", "A DOG on the mat" * 50, None, "\x00ü"]
    docs = make(new)
    trie = brute(train, order)
    want = [trie.text(t, False) for t in new]
    counts = ppm.corpus_counts(make(train), order=order)
    for grams, low in ((ppm.HELD_GRAMS, ppm.LOW_GRAMS), (3, ppm.LOW_GRAMS), (ppm.HELD_GRAMS, 0)):
        monkeypatch.setattr(ppm, "LOW_GRAMS", low)
        monkeypatch.setattr(ppm.frequent, "__defaults__", (grams,))
        got = [r["score"] for r in ppm.score(docs, counts, order=order).orderBy("doc_id").collect()]
        assert np.allclose(got, want, atol=1e-6), (grams, low)


def test_ppm_probabilities_add_up():
    raw = [np.frombuffer(t.encode(), np.uint8) for t in ("abracadabra alakazam", "abba")]
    key, n = ppm.merged(*zip(*(ppm.grams_of(x, np.array([0, len(x)]), 3) for x in raw)))
    for context in {int(k) >> 8 for k in key} | {0x010203}:
        every = np.uint64(context << 8) | np.arange(256, dtype=np.uint64)
        both, counts = ppm.merged([key, every], [n, np.zeros(256, np.int64)])
        cost = ppm.costs_of(both, counts, [], 3)
        assert abs((10 ** cost[np.searchsorted(both, every)]).sum() - 1) < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_ppm_query_on_held_out_rows(spark, data, sf):
    """Equal to a trie in memory on the small tables; on the larger ones ahead of the word base."""
    at = data.replace("sf0.001", sf)
    got = ppm.op1_ppm(spark, at).toPandas().set_index("doc_id")
    if sf == "sf0.001":
        rows = texts(spark, at)
        trie = brute([t for i, t in zip(rows.doc_id, rows.text) if zlib.crc32(str(i).encode()) % 10])
        some = rows[rows.text.str.len() < 3000]
        assert len(some) > 100 and np.allclose(got.score.loc[some.doc_id], [trie.text(t, False) for t in some.text], rtol=1e-9)
    else:
        held = got[got.held_out]
        assert len(held) > 900 and held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.8


def test_long_words_are_told_apart(spark, make):
    """Two words of 1,024 letters whose sums of powers modulo 2**64 are equal."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    got = ppm.score(make([other]), ppm.corpus_counts(make([word])), order=2).collect()
    assert got[0]["n_known"] == 1  # the end only


def test_ppm_odd(spark, odd, none):
    counts = ppm.corpus_counts(odd)
    got = ppm.score(odd, counts).collect()
    assert len(got) == odd.count() and all(r["score"] < 0 for r in got)
    assert ppm.score(none, counts).count() == 0
    empty = ppm.score(odd, ppm.corpus_counts(none)).collect()
    assert len(empty) == odd.count() and all(r["n_known"] == 0 for r in empty)
    adaptive = ppm.score_adaptive(odd.where("length(text) < 6000 or text is null").select("doc_id", "text")).collect()
    assert all(r["adaptive_score"] < 0 for r in adaptive)


# -- 2 ----------------------------------------------------------------------------------------------


def word_statistics(t):
    w = WORD.findall(t or "")
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, data, odd):
    extra = odd.select("doc_id", "text").where("text is null or length(text) < 6000")
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(extra)
    got = rows.select(F.struct("doc_id", "text").alias("doc_id"), "text")
    for r in quality.statistics(got).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == word_statistics(r["doc_id"]["text"])


def test_decision_list_finds_rules():
    r = random.Random(1)
    rows = []
    for _ in range(600):
        x = {"a": r.random(), "b": r.random()}
        rows.append((x, int(not (x["a"] > 0.8 or x["b"] < 0.1 and x["a"] < 0.5))))
    rules = quality.learn(rows, ["a", "b"])
    wrong = sum(any(quality.covers(rule, x) for rule in rules) == bool(x[1]) for x in rows)
    assert rules and wrong < 30


def test_quality_query(spark, data, odd, none):
    plan = quality.op2_quality(spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    got = {r["doc_id"]: r for r in quality.op2_quality(spark, data).collect()}
    for r in got.values():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    wrong = sum(got[i]["kept"] != bool(q) for i, q in labels.items() if not got[i]["base_failed"])
    assert wrong <= 0.1 * len(labels)
    assert quality.judge(odd, []).count() == odd.count() and quality.judge(none, []).count() == 0
    assert quality.fit(none, spark.createDataFrame([], "doc_id long, quality int")) == []


# -- 3 ----------------------------------------------------------------------------------------------


def test_bpe_equals_library(spark, data, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    rows = texts(spark, data)
    want = {}
    for i, t in zip(rows.doc_id, rows.text):
        e = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r[1:]) for r in bpe.op3_bpe(spark, data).collect()} == want
    r = random.Random(5)
    alphabet = "ab 1é\t\n\r\x0b\x1c\x85\xa0 'st.,!漢😀́"
    fuzz = ["".join(r.choice(alphabet) for _ in range(r.randrange(50))) for _ in range(400)] + ["<|endoftext|>x<|endoftext|>", "we're I'LL", "x" * 300, " " * 90 + "y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(fuzz)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for row in bpe.decode(bpe.encode(docs)).collect():
        assert row["ids"] == library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["decoded"] == (row["text"] or "") and row["n_tokens"] == len(row["ids"])
    assert bpe.encode(none).count() == 0 and bpe.encode(odd).count() == odd.count()


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): bytes([len(w), 0, 0, 0]) for w in ("walk", "walking", "talk", "talking", "walked", "talked", "w")}
    lexicon = bpe.Lexicon.map(bpe.Lexicon.compile(words).dump())
    found = lexicon.lookup([*sorted(words), b"wal", b"", b"talks"])
    assert found.tolist() == [*range(7), -1, -1, -1]
    # Root, w, t, then a, l, k, i, n, e and one end that all share.
    assert len(lexicon.final) == 10


# -- 4 ----------------------------------------------------------------------------------------------


def test_leaks(spark, data):
    docs, items = texts(spark, data), spark.read.parquet(f"{data}/benchmark.parquet").collect()
    want = {(i, x["item_id"]) for i, t in zip(docs.doc_id, docs.text) for x in items if x["text"] in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op4_decontaminate(spark, data).collect()}
    assert want and want <= got and len(got - want) <= 2


def test_search_equals_scoring_of_all():
    r = random.Random(2)
    items = [(i, " ".join(random_words(r.randrange(8, 40), i, 120)), "") for i in range(300)]
    index = decontaminate.Index.build(items, 5)
    for seed in range(60):
        words = random_words(90, 1000 + seed, 120) + items[seed][1].split()
        raw = " ".join(words).encode()
        hashes, _, _ = decontaminate.normal_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        terms = np.unique(index.terms(hashes)[index.terms(hashes) >= 0])
        scores = np.zeros(len(items))
        for t in terms:
            s = slice(index.start[t], index.start[t + 1])
            scores[index.item[s]] += index.impact[s]
        want = {int(i) for i in np.flatnonzero(scores >= 1)}
        assert {i for i, _ in index.search(terms)} == want and seed in want


def held_items(texts_, items, width=5, overlap=0.8):
    """(text, item) by plain sets over windows of all starts: question, answer and both."""
    edge = ".,;:!?\"'()[]"
    norm = lambda t: [x for w in WORD.findall((t or "").translate(LOWER)) if (x := w.strip(edge))]
    pieces = lambda w: {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    split = {i: decontaminate.split_item(t or "") if a is None else (t or "", a) for i, (t, a) in items.items()}
    longest = max(1, *(len(norm(q + "\n" + a)) for q, a in split.values()))
    out = set()
    for d, t in texts_.items():
        words = norm(t)
        for i, (q, a) in split.items():
            qw, aw = norm(q), norm(a)
            if not qw and not aw:
                continue
            for at in range(0, max(1, len(words)), longest):
                here = words[at : at + 2 * longest]
                share = lambda w: len(pieces(w) & {tuple(here[k : k + min(width, len(w))]) for k in range(len(here) - min(width, len(w)) + 1)}) / len(pieces(w)) if w else 1  # noqa: B023, E731
                if min(share(qw), share(aw), share(qw + aw)) >= overlap:
                    out.add((d, i))
    return out


def test_question_and_answer_both_decide(spark, make):
    q, a = " ".join(random_words(14, 1, 9999)), " ".join(random_words(7, 2, 9999))
    other = " ".join(random_words(7, 3, 9999))
    r = random.Random(5)
    items = {1: (q + "?", a), 2: (" ".join(random_words(20, 7, 9999)), ""), 3: (" ".join(random_words(12, 8, 9999)) + ". " + " ".join(random_words(6, 9, 9999)), None), 4: ("yes", "no")}
    noise = lambda n: " ".join(random_words(n, r.randrange(10**6), 9999))
    texts_ = [f"{noise(30)} {q} {a} {noise(20)}", f"{noise(30)} {q} {noise(40)}", f"{noise(10)} {q} {other}", f"{noise(10)} {a} {noise(30)}", items[2][0].upper(), f"{noise(3)} {items[3][0]}!", "yes no", "no", f"{noise(60)} {q}, {noise(1)} {a}", "", None]
    words = items[2][0].split()
    for k in range(1, 6):
        texts_.append(" ".join([*words[:-k], *random_words(k, 50 + k, 9999)]))
        texts_.append(f"{noise(9)} " + " ".join([*q.split()[k:], a]))
    bench = spark.createDataFrame([(i, t, x) for i, (t, x) in items.items() if x is not None], "item_id long, text string, answer string")
    docs = make(texts_)
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find(docs, bench, answer_col="answer").collect()}
    want = held_items(dict(enumerate(texts_)), {i: x for i, x in items.items() if x[1] is not None})
    assert got == want and {(0, 1), (4, 2), (6, 4)} <= got and not {(1, 1), (2, 1), (3, 1), (7, 4)} & got
    one = spark.createDataFrame([(3, items[3][0])], "item_id long, text string")
    assert [(x["doc_id"], x["item_id"]) for x in decontaminate.find(docs, one).collect()] == [(5, 3)]


def test_leaks_equal_brute_force(spark, data):
    docs = texts(spark, data)
    items = {x["item_id"]: (x["text"], None) for x in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    want = held_items(dict(zip(docs.doc_id, docs.text)), items)
    assert want and {(r["doc_id"], r["item_id"]) for r in decontaminate.op4_decontaminate(spark, data).collect()} == want


def test_leaks_odd(spark, odd, none, make):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten. the answer is eleven"), (2, None), (3, ""), (4, "tiny")], "item_id long, text string")
    docs = make(["x y One, two three four five six seven eight nine ten. The answer is eleven!", "unrelated", None, "so tiny it is"], "score item_id")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, items).collect()} == {(0, 1), (3, 4)}
    assert [r["doc_id"] for r in decontaminate.remove_contaminated(docs, items).orderBy("doc_id").collect()] == [1, 2]
    assert decontaminate.find(odd, items.limit(0)).count() == 0 and decontaminate.find(none, items).count() == 0
    assert decontaminate.remove_contaminated(odd, items.limit(0)).count() == odd.count()
    assert decontaminate.remove_contaminated(odd, items).columns == odd.columns


# -- 5 ----------------------------------------------------------------------------------------------


def para(seed, n=30):
    return " ".join(random_words(n, seed, 10_000))


def test_repeated_runs_go(spark, make):
    a, b, c = para(1, 60), para(2, 12), para(3, 45)
    docs = make(["intro\n" + "\n".join([a, b, c]) + "\nend", "other start\n" + "\n".join([a, b, c]) + "\nfin", b + "\n" + para(9), f"{a}\n\nmiddle\n{a}", "short\nshort"])
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert got[0].split("\n") == ["intro", a, b, c, "end"]
    assert got[1] == "other start\nfin"
    assert got[2] == b + "\n" + para(9) and got[4] == "short\nshort"
    assert got[3] == "\nmiddle"


def test_runs_of_enough_words_are_all_found(spark, data):
    rows = texts(spark, data)
    got = linededup.op5_linededup(spark, data)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    after = {r["doc_id"]: r["text"] for r in got.collect()}
    seen, missed, total = {}, 0, 0
    for i, t in zip(rows.doc_id, rows.text):
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = [len(WORD.findall(x)) for x in lines]
        left = collections.Counter(after[i].split("\n"))
        gone = collections.Counter(lines) - left
        runs = []
        for p in range(len(lines)):
            q = w = 0
            q = p
            while q < len(lines) and w < 50:
                w += n[q]
                q += 1
            if w >= 50:
                runs.append((tuple(lines[p:q]), range(p, q)))
        for key, where in runs:
            if key in seen and seen[key] != i:
                total += 1
                missed += any(not gone[lines[k]] for k in where)
        for key, _ in runs:
            seen.setdefault(key, i)
    assert total and not missed


def cut(docs, noise=25, sure=50):
    """What is left of documents (id: text) whose ids are distinct, by plain loops."""
    import xxhash

    def digest(value, seed):
        return xxhash.xxh64_intdigest(value if isinstance(value, bytes) else (value % (1 << 64)).to_bytes(8, "little"), seed)

    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x

    def gram(lines, p, words, step=1, seed=42):
        s, k, g = 0, p, seed
        while 0 <= k < len(lines) and s < words:
            s, g, k = s + lines[k][2], digest(lines[k][1], digest(g, 42)), k + step
        return (signed(g), p, k) if s >= words else None

    table, picks = {}, collections.defaultdict(list)
    for i, t in docs.items():
        lines = [(k, signed(digest(x.encode(), 42)), len(WORD.findall(x))) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        table[i], mine = lines, {}
        for p in range(len(lines)):
            if window := gram(lines, p, sure):
                fits = [y for k in range(p, window[2]) if (y := gram(lines, k, noise)) and y[2] <= window[2]]
                if fits:
                    g, q, _ = min(fits, key=lambda y: (y[0], -y[1]))
                    mine[g] = min(q, mine.get(g, q))
        for g, q in mine.items():
            picks[g].append((i, q))
    matched = collections.defaultdict(set)
    for where in picks.values():
        for i, q in where if len(where) > 1 else ():
            matched[i] |= {q} if (i, q) != min(where) else set()
    gone, places = collections.defaultdict(set), collections.defaultdict(list)
    for i, lines in table.items():
        seen = set()
        for p in range(len(lines)):
            if y := gram(lines, p, noise):
                if y[0] in seen:
                    gone[i] |= set(range(y[1], y[2]))
                seen.add(y[0])
                places["on", y[0]].append((i, p, y[2]))
            if y := gram(lines, p, noise, -1, 43):
                places["back", y[0]].append((i, y[2] + 1, p + 1))
    spans = collections.defaultdict(list)
    for where in places.values():
        where = [w for w in where if w[0] in matched]
        for w in where:
            if w[:2] != min(where)[:2]:
                spans[w[0]].append(w[1:])
    for i, found in spans.items():
        runs = []
        for a, b in sorted(found):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        for a, b in runs:
            if any(a <= q < b for q in matched[i]):
                gone[i] |= set(range(a, b))
    return {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in {table[i][j][0] for j in gone[i]}) for i, t in docs.items()}


def test_lines_equal_brute_force(spark, data, make):
    rows = texts(spark, data)
    r = random.Random(12)
    pool = [para(100 + k, r.choice([2, 6, 12, 30, 60])) for k in range(60)]
    made = {10**6 + k: "\n".join(["", *(r.choice(pool) if r.random() < 0.6 else para(r.randrange(10**6), 9) for _ in range(r.randrange(1, 14)))]) for k in range(150)}
    docs = {**dict(zip(rows.doc_id.tolist(), rows.text)), **made, 5 * 10**6: None, 5 * 10**6 + 1: ""}
    want = cut(docs)
    assert sum(want[i] != docs[i] for i in docs) > 60
    frame = make(list(docs.items()))
    got = linededup.dedup_lines(frame.unionByName(frame.limit(40))).collect()  # repeated rows are cut alike
    assert len(got) == len(docs) + 40 and {x["doc_id"]: x["text"] for x in got} == want and all(x["text"] == want[x["doc_id"]] for x in got)


def test_runs_with_other_partners(spark, make):
    """The middle of a run stands in an earlier document, or at several places there."""
    docs, around = [], {}
    for seed in range(12):
        one, mid, three = (para(1000 * seed + k, 30) for k in range(3))
        x = around[seed] = [para(1000 * seed + 10 + k, 30) for k in range(7)]
        docs += ["\n".join(t) for t in ([x[0], mid, x[1], x[2], mid], [x[3], one, mid, three, x[4]], [x[5], one, mid, three, x[6]])]
    got = {r["doc_id"]: r["text"].split("\n") for r in linededup.dedup_lines(make(docs)).collect()}
    for seed, x in around.items():
        assert got[3 * seed + 2] == [x[5], x[6]] and len(got[3 * seed + 1]) >= 4


def test_many_equal_rows_make_few_rows(spark, make):
    text = "\n".join(para(k, 30) for k in range(4))
    docs = make([(1, text)] * 400 + [(2, text)] * 400 + [(3, text + "\nmore")])
    got = collections.Counter((r["doc_id"], r["text"]) for r in linededup.dedup_lines(docs).collect())
    assert got == {(1, text): 400, (2, ""): 400, (3, "more"): 1}


def test_lines_odd(spark, odd, none):
    out = linededup.dedup_lines(odd, counts=True)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert {r["doc_id"]: r["text"] for r in out.collect()}[0] is None
    assert linededup.dedup_lines(none).count() == 0
    assert linededup.dedup_lines(odd, drop_emptied=True, length_col="n_chars").columns == odd.columns


# -- 6 ----------------------------------------------------------------------------------------------


def test_suffix_sorting():
    r = random.Random(1)
    for _ in range(150):
        n, most = r.randrange(60), r.choice([1, 2, 3, 5, 30])
        t = [r.randint(1, most) for _ in range(n)]
        t = [*t, *t[: n // 2], *t, 0] if r.random() < 0.4 else [*t, 0]
        order = sorted(range(len(t)), key=lambda i: t[i:])
        common_prefix = [0] * len(t)
        for k in range(1, len(t)):
            a, b = order[k - 1], order[k]
            while t[a + common_prefix[k] : a + common_prefix[k] + 1] == t[b + common_prefix[k] : b + common_prefix[k] + 1] != []:
                common_prefix[k] += 1
        got = suffix.sort_suffixes(np.array(t, np.int64))
        assert (list(got[0]), list(got[1])) == (order, common_prefix)


def test_suffix_sorting_from_files(monkeypatch):
    """A text of thirty times the entries that are allowed in memory: the order is the same, and the peak a small part."""
    import tracemalloc

    def sort(t):
        tracemalloc.start()
        out = suffix.sort_suffixes(t, 400)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak

    r = random.Random(4)
    some = np.random.default_rng(4).integers(1, 4, 40_000)
    t = np.concatenate([some, np.full(1000, 2), some[:20_000], [0]])
    want, whole = sort(t)
    raw = bytes(t.tolist())
    assert all(raw[a:] < raw[b:] for a, b in r.sample(list(zip(want[0].tolist(), want[0][1:].tolist())), 2000))
    monkeypatch.setattr(suffix, "IN_MEMORY", 2000)
    monkeypatch.setattr(suffix, "BLOCK", 1000)
    held = suffix.room(len(t))
    held[:] = t
    got, peak = sort(held)
    assert all((x == y).all() for x, y in zip(got, want)) and 5 * peak < whole and peak < 1_500_000


@pytest.mark.parametrize("limit", [5, 40])
def test_suffix_sorting_in_blocks(monkeypatch, limit):
    monkeypatch.setattr(suffix, "IN_MEMORY", limit)
    monkeypatch.setattr(suffix, "BLOCK", 3 if limit < 10 else 16)
    test_suffix_sorting()


def removed(rows, length=400):
    raw = [(t or "").encode() for t in rows]
    count = collections.Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, make):
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared, other = letters(700), letters(1500)
    rows = [letters(300) + shared + letters(200), shared[:450] + letters(900), letters(50) + shared[100:560], other, other, other[:700] + "Z" + other[701:], letters(2000), "ab" * 700, None, "", shared[:399], letters(600) + other[200:620] + other[300:760]]
    docs = make([(i % 11 if i < 11 else None, t) for i, t in enumerate(rows)])
    got = suffix.remove_repeats(docs)
    assert sorted(tuple(x[1:]) for x in got.collect()) == sorted(removed(rows))


@pytest.mark.parametrize("hot", [1, 6])
def test_hot_groups_equal_brute_force(spark, make, monkeypatch, hot):
    """Passages that many documents share, some just under and some over the length, in other surroundings."""
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 20_000)
    r = random.Random(hot)
    letters = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passages = [letters(n) for n in (170, 340, 380, 395, 402, 430, 600)]
    sides = [letters(30) for _ in range(6)]
    rows = [letters(r.randrange(300)) + r.choice([*sides, ""]) + r.choice(passages) + r.choice([*sides, letters(9)]) + letters(r.randrange(300)) for _ in range(120)]
    got = suffix.remove_repeats(make(rows), rest=True).orderBy("doc_id").collect()
    want = removed(rows)
    assert [tuple(x[1:5]) for x in got] == want and 20 < sum(w[1] > 0 for w in want) < 120
    assert all(len(x["text"].encode()) <= x["n_bytes"] - x["n_removed"] for x in got)
    assert all(x["text"] == t for x, t, w in zip(got, rows, want) if not w[1])


def test_repeats_odd(spark, odd, none):
    got = suffix.remove_repeats(odd).collect()
    assert len(got) == odd.count() and suffix.remove_repeats(none).count() == 0
    want = removed([r["text"] if r["text"] is None or len(r["text"]) < 6000 else None for r in odd.collect()])
    small = [tuple(r[1:]) for r in got if r["n_bytes"] < 6000]
    assert sorted(small) == sorted(w for w, r in zip(want, odd.collect()) if len((r["text"] or "").encode()) < 6000)


# -- 7 ----------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header><div>Site name</div></header><nav><ul><li>Home<li>About</ul></nav><div class="notice">We use cookies</div>
<div id="x1"><span>Menu of the site</span></div><article><h1>Title {i} &amp; more</h1><p>First   {i}<b>bold</b> text.<p>Second&nbsp;{i}<br>part &lt;x&gt;
<div class="ad">Buy</div><p>Third {i}</p><form><input value="q">Search</form><section class="comments"><p>Nice</p></section></article>
<aside>Links</aside><footer>&copy; Site</footer></body></html>"""


def test_main_text(spark, none):
    rows = [(i, "http://www.a.example/p", PAGE.format(i=i)) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", f"<body><div>Shared banner text</div><div><p>Body {i} only</p></div><div>Shared foot</div>") for i in range(12)]
    rows += [(200, "http://c.example", None), (201, None, ""), (202, "x", "plain text"), (203, "http://c.example", "<p>open <b>tags"), (204, "http://c.example", "a<script>b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for how in (html.BROADCAST, -1):
        got = {r["page_id"]: r["text"] for r in html.extract(pages, broadcast=how).collect()}
        for i in range(12):
            assert got[i] == f"Title {i} & more\nFirst {i}bold text.\nSecond {i} part <x>\nThird {i}"
            assert got[100 + i] == f"Body {i} only"
        assert (got[200], got[201], got[202], got[203], got[204]) == ("", "", "plain text", "open tags", "a")
    assert html.extract(pages.limit(0)).count() == 0


def test_blocks_in_articles_and_copies_of_pages(spark):
    box = "<div class=x><p>Read also these stories</p><ul><li>One</li><li>Two</li></ul></div>"
    rows = [(i, "http://a.example/", f"<body><article><p>Own text of page {i} " + f"word{i} " * 20 + f"</p><p>Same line</p>{box}</article></body>") for i in range(6)]
    copy = "<body><div><p>The whole story " + "again " * 20 + "</p><p>Its second part</p></div><p>{}</p></body>"
    rows += [(10 + i, "http://b.example/", copy.format(f"No. {i}")) for i in range(4)]
    rows += [(20 + i, "http://c.example/", copy.format("same")) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"Own text of page {i}" in got[i] and "Same line" in got[i] and "Read also" not in got[i] and "Two" not in got[i] for i in range(6))
    assert all("The whole story" in got[k + i] and "Its second part" in got[k + i] for k in (10, 20) for i in range(4))


@pytest.mark.parametrize("bad", ["<a ", "<a", "<div>", "<a \"", "<!", "<!--", "<b><div>", "</x>", "<div></x>", "a" * 50, "<p x", "<i></b>", "<td>", "&amp;", "<a b=c ", "<script>", "<div class='a"])
def test_broken_pages_of_a_megabyte(bad):
    import time

    start = time.time()
    html._extract("http://x.example", "<div><li>" + bad * (1_000_000 // len(bad)) + "><p>end</p>", frozenset())
    assert time.time() - start < 12


def test_odd_pages(spark):
    """Repeated rows, clashing columns, and tags that the scanner meets."""
    rows = [(i, "u", "<p>same</p>") for i in (1, 1, 2)] + [(3, "u", "<P CLASS='a>b'>x<BR/>y</P ><a href=\"q'>z\">w</a> 1 < 2 <3 </p>& <![CDATA[no]]><!-- no --><?php no ?>v<")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in "id key host kind rest h n _quorix page title rows".split():
        pages = pages.withColumn(name, F.lit("x")) if name not in ("html",) else pages
    for how in (html.BROADCAST, -1):
        got = html.extract(pages, broadcast=how)
        assert set(pages.columns) - {"html"} | {"text"} == set(got.columns)
        assert sorted((r["page_id"], r["text"]) for r in got.collect()) == [(1, "same"), (1, "same"), (2, "same"), (3, "x y\nw 1 < 2 <3 & v<")]


def test_template_changes_pages_without_article(spark):
    rows = [(i, "http://s.example/", f"<div><span>Top of the site</span><p>Story {i} " + f"w{i} " * 30 + f"</p><div>All about us</div></div>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    off = {r["page_id"]: r["text"] for r in html.extract(pages, least=10**6).collect()}
    on = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert all("Top of the site" in off[i] and "All about us" in off[i] and on[i] == (f"Story {i} " + f"w{i} " * 30).strip() for i in range(8))


def test_pages_of_the_table(spark, data):
    got = html.op7_html(spark, data).collect()
    assert len(got) == 50 and all(r["n_chars"] == len(r["text"]) > 0 and "©" not in r["text"] for r in got)


# -- 8 ----------------------------------------------------------------------------------------------


def test_fingerprints(spark, odd):
    import xxhash

    got = {(r["doc_id"], r["text"]): r["fp"] for r in simhash.fingerprints(odd.select("doc_id", "text")).join(odd.select("doc_id", "text"), "doc_id").collect()}
    for (i, t), fp in got.items():
        w = WORD.findall((t or "").translate(LOWER))
        pieces = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert fp % (1 << 64) == want


def clusters(x, most):
    root = list(range(len(x)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= most) + i + 1:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


@pytest.mark.parametrize("most", [2, 4, 6])
def test_links_equal_all_pairs(spark, most):
    r = random.Random(most)
    x = [r.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        v = r.choice(x)
        for _ in range(r.randrange(most + 3)):
            v ^= 1 << r.randrange(64)
        x.append(v)
    hub = x[0]
    x = np.array(sorted({*x, *(hub ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a))}), np.uint64)
    classes = spark.createDataFrame([(int(v) - (1 << 64) if v >= 1 << 63 else int(v), i) for i, v in enumerate(x)], "fp long, rep long").repartition(4)
    n, both = simhash.bit_statistics(classes)
    assert n == len(x)
    found = {e["node"]: e["component"] for e in common.components(simhash.near_edges(classes, simhash.plan(n, both, x[:200], most), most)).collect()}
    assert [found.get(i, i) for i in range(len(x))] == clusters(x, most)


def test_near_copies(spark, data, odd, none):
    got = simhash.op8_simhash(spark, data).orderBy("doc_id").collect()
    x = np.array([int(r["fingerprint"], 16) for r in got], np.uint64)
    assert [r["component_id"] for r in got] == [got[i]["doc_id"] for i in clusters(x, 4)]
    assert simhash.near_components(odd).count() == odd.count() and simhash.near_components(none).count() == 0


# -- 9 ----------------------------------------------------------------------------------------------


def test_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 3000)
    r = random.Random(6)
    same = "<p>same</p>" * 20
    rows = [(i * 7, f"http://h.example/ü {i}\n", same if i % 3 == 0 else "".join(r.choice("abc<>é") for _ in range(r.randrange(400)))) for i in range(60)]
    rows += [(10**15, None, same), (5, "u", None), (6, "u", ""), (None, "u", same), (7, "again", "<x>"), (7, "again", "<x>"), (10**15, None, same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("d", F.lit("clash"))
    path = warc.write(pages, file_bytes=500)
    manifest = spark.read.parquet(f"{path}/_manifest").orderBy("file").collect()
    other = warc.write(pages.repartition(7, "html"), file_bytes=500)
    assert [tuple(m) for m in manifest] == [tuple(m) for m in spark.read.parquet(f"{other}/_manifest").orderBy("file").collect()] and len(manifest) > 5
    for m in manifest:
        raw = open(f"{path[7:]}/{m['file']}", "rb").read()
        assert hashlib.sha1(raw).hexdigest() == m["sha1"] and gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    own = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[own(h)] = max(i, largest.get(own(h), i))
    got = collections.defaultdict(list)
    for x in warc.read(spark, path, True).collect():
        got[x["page_id"], x["payload_digest"], x["url"]].append(x)
        assert x["record_type"] == "revisit" or own(x["html"]) == x["payload_digest"]
    assert sum(map(len, got.values())) == len(rows)
    for i, u, h in rows:
        found = got[i, own(h), u]
        kinds = [x["record_type"] for x in found]
        assert found and {x["payload_bytes"] for x in found} == {len((h or "").encode())}
        if i is None or i == largest[own(h)]:
            assert kinds.count("response") == 1
        else:
            assert set(kinds) == {"revisit"}
        assert all(x["refers_to"] == largest[own(h)] for x in found if x["record_type"] == "revisit")
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_damage_is_seen():
    raw = warc.record(1, "http://x", b"hello", None)
    assert warc.parse(raw)[:3] == (1, "http://x", "response")
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"hello", b"hallo"))


# -- 10 ---------------------------------------------------------------------------------------------


def test_toxicity(spark):
    r = random.Random(9)
    bad = ["moronic", "idiotic", "scumbag", "trashy"]
    rows = []
    for i in range(700):
        w = random_words(r.randrange(20, 200), i, 3000)
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])

    def chance(text):
        raw = text.encode()
        return float(model.probability(toxicity.window_scores(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model))[0])

    clean = [" ".join(random_words(100, 5000 + k, 3000)) for k in range(60)]
    found = [" ".join([*random_words(100, 6000 + k, 3000), *r.sample(bad, 3)]) for k in range(60)]
    misspelt = [" ".join([*random_words(100, 7000 + k, 3000), "morronic", "idiottic", "scumbags"]) for k in range(60)]
    assert np.mean([chance(t) >= 0.3 for t in clean]) < 0.1
    assert np.mean([chance(t) >= 0.3 for t in found]) > 0.9
    assert np.mean([chance(t) >= 0.3 for t in misspelt]) > 0.7


def test_toxicity_on_held_out_rows(spark, data):
    """Labelled rows that nothing was learned or chosen from."""
    folder = data.replace("sf0.001", "sf0.1")
    out = toxicity.op10_toxicity(spark, folder).where("held_out")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = {(r["y"], r["predicted"]): r["count"] for r in out.join(labels, "doc_id").groupBy("y", "predicted").count().collect()}
    assert n[1, 1] > 0.75 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) < 0.02 * n[0, 0]


def test_toxicity_odd(spark, data, odd, none):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, labels) is None and {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}
    out = toxicity.op10_toxicity(spark, data).collect()
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out) and any(r["held_out"] for r in out)


# -- all --------------------------------------------------------------------------------------------


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))
