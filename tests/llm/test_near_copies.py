"""Near copies of the pipeline's second stage against brute force on five-word shingles."""

import random

import pytest

import corpus_pipeline
from loglode.llm import near_copies

from .test_operators import WORDS, frame


def grams(text):
    w = (text or "").encode().lower().split()  # lower-cases A-Z, cuts at ASCII white space
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    a, b = grams(a), grams(b)
    return bool(a and b) and 9 * len(a & b) >= 4 * (len(a) + len(b))


def near_rows():
    """Texts with copies of which up to a tenth of the words differ, a chain, a crowd of near copies, and odd rows."""
    r = random.Random(3)
    text = lambda k: [r.choice(WORDS) + str(r.randrange(400)) for _ in range(k)]
    rows, n = [], 0
    for _ in range(40):
        base = text(r.randrange(60, 300))
        rows.append((n, " ".join(base)))
        for k in (1, 2, 4, 7):
            t = list(base)
            for at in r.sample(range(len(t)), k):
                t[at] = f"x{n}"
            rows.append((n + k, " ".join(t)))
        n += 10
    crowd = text(200)
    for k in range(80):
        t = list(crowd)
        for at in r.sample(range(200), 3):
            t[at] = f"y{k}"
        rows.append((1000 + k, " ".join(t)))
    return rows + [(2000, None), (2001, ""), (2002, "a b"), (2003, "a b"), (2004, "a b c"), (None, rows[0][1] + " z"), (5, "repeated id of its own words here and there")]


@pytest.fixture(scope="module")
def rows():
    return near_rows()


def test_components_equal_brute_force(spark, rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if similar(rows[a][1], rows[b][1]):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(find(k), set()).add(i)
    want = sorted(((i, min(x for x in low[find(k)] if x is not None)) for k, (i, t) in enumerate(rows) if t), key=str)
    got = sorted(((x.doc_id, x.component_id) for x in near_copies.near_copy_components(frame(spark, rows)).collect()), key=str)
    assert got == want


def test_stage_leaves_no_near_copies(spark, rows):
    kept = [x.text for x in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows).where("doc_id IS NOT NULL"), "").collect()]
    assert len(kept) >= 40
    assert not [1 for a in range(len(kept)) for b in range(a) if similar(kept[a], kept[b])]


def test_pair_at_the_threshold_shares_a_band():
    r, missed = random.Random(4), 0
    for _ in range(500):
        base = [f"w{r.randrange(10**6)}" for _ in range(94)]  # 90 shingles, 80 of them in both: 80 / 100
        a, b = near_copies.shingle_hashes([" ".join(base), " ".join(base[10:] + [f"v{r.randrange(10**6)}" for _ in range(10)])])
        missed += not set(near_copies.bands(a).tolist()) & set(near_copies.bands(b).tolist())
    assert missed == 0


def test_scratch_tables_hold_texts_and_minima_once(spark):
    import glob

    from loglode.llm.common import recorded_scratch

    docs = spark.createDataFrame([(i, f"some words of a text that is number {i // 2} and no other") for i in range(40)], "doc_id long, text string")
    with recorded_scratch() as named:
        got = near_copies.near_copy_components(docs)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, i // 2 * 2) for i in range(40)}
    files = lambda name: [f for p in named if f"/{name}-" in p for f in glob.glob(p.removeprefix("file://") + "/*.parquet")]
    assert files("numbered") and all(f.endswith(".zstd.parquet") for f in files("numbered"))
    assert files("keys") and not files("minima")
