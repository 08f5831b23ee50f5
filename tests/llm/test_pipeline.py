"""The pipeline: each stage on its own input, and the whole."""

import random

import corpus_pipeline as pipeline
import pytest
from quorix.llm import nearcopies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_whole(spark, data):
    out = pipeline.run(spark, data)
    rows = out.collect()
    before = spark.read.parquet(f"{data}/documents.parquet").count()
    assert 0.6 * before < len(rows) < before and len({r["doc_id"] for r in rows}) == len(rows)
    assert all(r["n_tokens"] == len(r["ids"]) and r["n_chars"] == len(r["text"]) for r in rows)
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert not any(i in r["text"] for r in rows for i in items)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & {r["doc_id"] for r in rows}) <= 0.3 * len(toxic)


def test_stages_on_odd_rows(spark, data, odd, none):
    docs = odd.select(*COLUMNS)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, data)
        assert out.columns[:5] == COLUMNS, name
        ids = {r["doc_id"] for r in out.collect()}
        assert ids <= {r["doc_id"] for r in docs.collect()}, name
        assert stage(spark, none.select(*COLUMNS), data).count() == 0, name
        if name != "near_copies":
            assert {0, 1, 3, 7} <= ids, name


def shingles(text, n=5):
    words = text.lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


@pytest.mark.parametrize("block", [400, 250_000])
def test_near_copies_equal_brute_force(spark, make, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "SMALL", 3)
    r = random.Random(8)
    texts = []
    for k in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 300))]
        texts.append(" ".join(base))
        # Runs of changed words leave similarities from about 0.6 to 1; a few families are larger than a small bucket.
        for _ in range(30 if k < 3 else 4):
            copy, share = list(base), r.uniform(0, 0.25)
            at, n = r.randrange(len(base)), int(len(base) * share)
            for i in range(at, min(at + n, len(base))):
                copy[i] = f"x{r.randrange(3000)}"
            texts.append(" ".join(copy))
    r.shuffle(texts)
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    near = 0
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                near += 5 * len(sets[a] & sets[b]) < 4.5 * len(sets[a] | sets[b])
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert near > 50
    got = pipeline.drop_near_copies(spark, make(texts), "").collect()
    assert sorted(x["doc_id"] for x in got) == [i for i in range(len(texts)) if find(i) == i]


def test_rows_of_one_id_are_told_apart(spark, make):
    docs = make([(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, "nothing like the others at all here")])
    got = pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(x["text"] for x in got) == ["alpha beta gamma delta epsilon zeta", "nothing like the others at all here", "one two three four five six seven"]


def test_fingerprints_give_candidates(spark, make, monkeypatch):
    """Without any band, SimHash alone brings texts of near equal fingerprints together; those below the similarity stay."""
    monkeypatch.setattr(nearcopies, "buckets", lambda classes, share: classes.sparkSession.createDataFrame([], "key long, u long, v long, n long"))
    r = random.Random(4)
    base = [[f"w{r.randrange(3000)}" for _ in range(400)] for _ in range(3)]
    texts = [" ".join(x) for x in base] + [" ".join([*base[0][:-1], "other"]), " ".join([*base[1], "more"])]
    got = pipeline.drop_near_copies(spark, make(texts), "").collect()
    assert sorted(x["doc_id"] for x in got) == [0, 1, 2]
