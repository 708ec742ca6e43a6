"""The Jaccard join against all pairs."""

import random

import pytest
from llm_cases import messy, nothing, prose, rows_of  # noqa: F401

from qamill.llm import jaccard
from qamill.llm.components import components


def plain_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([b" ".join(words)])
    return frozenset(b" ".join(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Component of each row by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((rows[i][0], len(sets[i]), least.get(root(i))) for i in range(len(rows))), key=str)


def joined(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join(df))), key=str)


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def family(seed):
    """Near copies at every distance around the limit, a passage that all texts share, and chains."""
    rng = random.Random(seed)
    fresh = lambda n: " ".join(f"x{rng.randrange(10**7)}" for _ in range(n))
    passage = fresh(40)
    texts = []
    for _ in range(6):
        base = fresh(rng.randint(20, 160))
        texts += [base] * rng.randint(1, 3) + [edited(base, rng, rng.randint(0, 6)) for _ in range(8)]
        chain = base
        for _ in range(6):
            chain = edited(chain, rng, rng.randint(1, 3))
            texts.append(chain)
    texts += [f"{fresh(rng.randint(1, 25))} {passage} {fresh(rng.randint(1, 25))}" for _ in range(40)]
    texts += [passage, passage.upper(), "a b c", "A  b\tc", "a b c d", "", " "]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,hot", [(1, 24), (2, 3), (3, 10**6)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, hot):
    """Whatever counts as frequent, the links are the same."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = family(seed)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_pairs_that_no_pivot_links(spark):
    """Two linked texts in a cell whose pivots are far from both are found by the windows."""
    rng = random.Random(8)
    core = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(24):  # share 60 words, far from each other in pairs of twins
        own = [f"o{rng.randrange(10**7)}" for _ in range(14)]
        text = " ".join(core + own)
        rows += [(3 * i, text), (3 * i + 1, edited(text, rng, 1))]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_messy_rows(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(messy.select("doc_id", "text"))]
    assert joined(messy) == brute(rows)
    assert joined(nothing) == []


def test_long_texts_are_hashed_in_steps(monkeypatch):
    text = jaccard.normal(prose(5, 3000))
    whole = jaccard.shingle_set(text)
    monkeypatch.setattr(jaccard, "STEP", 100)
    assert (jaccard.shingle_set(text) == whole).all()
    assert len(whole) == len(plain_set(text.decode()))


def test_one_large_group_makes_no_pairs(spark):
    """Copies are one class, and near copies meet their pivot only."""
    rng = random.Random(4)
    base = " ".join(f"x{i}" for i in range(100))
    rows = [(i, base if i < 300 else edited(base, rng, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = jaccard.survey(df).where("t IS NOT NULL").select("t", "c")
    cells = jaccard._cells(jaccard.prefixes(df, jaccard.frequent_shingles(counts)))
    pairs = cells.where("k <> p").select("k", "p").distinct().count()
    assert pairs < 301 * 8
    assert {r[2] for r in joined(df)} == {0}


def test_near_copies_at_all_distances_leave_no_pairs_of_members(spark, monkeypatch):
    """A large group around one text, most of them too unlike to be linked with each other, is settled by central pivots."""
    rng = random.Random(11)
    base = " ".join(f"x{i}" for i in range(150))
    rows = [(i, edited(base, rng, i % 6)) for i in range(300)]
    left, windows = [], jaccard._window_pairs
    monkeypatch.setattr(jaccard, "_window_pairs", lambda cells: left.append(windows(cells).count()) or windows(cells))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert sum(left) < 300


def test_sketches_never_exceed_the_sets_difference():
    rng = random.Random(6)
    for _ in range(50):
        text = prose(rng.randrange(1000), rng.randint(5, 200))
        one, two = (jaccard.shingle_set(jaccard.normal(t)) for t in (text, edited(text, rng, 5)))
        for parts in (jaccard.SKETCH, jaccard.FINE):
            apart = abs(jaccard.sketch(one, parts).astype(int) - jaccard.sketch(two, parts).astype(int)).sum()
            assert apart <= len(set(one.tolist()) ^ set(two.tolist()))


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r["k"]: r["label"] for r in rows_of(components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {**{i: 1 for i in range(1, 41)}, **{1000 + i: 1000 for i in range(200)}}


def test_copies_of_components_are_not_broadcast(spark):
    """Every component stands in CELLS copies, which Spark sizes as one: it broadcast them all."""
    rows = spark.createDataFrame([(i, prose(i % 7, 30)) for i in range(40)], "doc_id long, text string")
    out = jaccard.join(rows)
    assert len({r["component_id"] for r in rows_of(out)}) == 7
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_s#" in plan and not [line for line in plan.split("\n") if "BroadcastHashJoin" in line and "_s#" in line]
