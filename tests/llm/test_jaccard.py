"""Pairs compared in groups of near copies, and the parity bits that tell sets apart."""

import random
import time

import numpy as np

from polyglossa.llm import jaccard

from test_graph import plain


def near_copies(n, words=100):
    """Copies of one text with 0 to 14 words replaced by new ones; over half of them link with none."""
    r = random.Random(n)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for _ in range(n):
        own = list(base)
        for _ in range(min(14, int(r.expovariate(0.25)))):
            own[r.randrange(words)] = f"x{r.randrange(10**9)}"
        texts.append(" ".join(own))
    return texts


def compared(spark, monkeypatch, texts):
    """Components, and the pairs that each turn has left to answer."""
    seen, real = [], jaccard._derived

    def derived(pairs, answers):
        seen.append(pairs.count())
        return real(pairs, answers)

    monkeypatch.setattr(jaccard, "_derived", derived)
    out = jaccard.join_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    monkeypatch.setattr(jaccard, "_derived", real)
    return {r.doc_id: r.component_id for r in out}, seen


def test_group_grows(spark, monkeypatch):
    """The last turn, which takes every pair still open, is left with fewer pairs than the group has copies."""
    texts = near_copies(700)
    found, seen = compared(spark, monkeypatch, texts)
    sets = [{" ".join(t.split()[k : k + 5]) for k in range(96)} for t in texts]
    links = [(i, j) for i in range(700) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = plain(links)
    assert found == {i: want.get(i, i) for i in range(700)}
    assert len(links) > 10 * 700 and sum(i not in want for i in range(700)) > 200
    assert seen[-1] < 700, seen


def test_parity():
    """Bits never differ in more places than sets do, folded or not; far sets are told apart."""
    r = np.random.default_rng(5)
    for size in (1, 3, 40, 146, 900, 20_000):
        base = r.integers(0, 1 << 63, size, dtype=np.uint64)
        for less, more in ((0, 0), (1, 0), (size // 10, size // 8), (size // 3, size // 2)):
            a, b = np.unique(base), np.unique(np.r_[base[less:], r.integers(0, 1 << 63, more, dtype=np.uint64)])
            x, y = (np.frombuffer(jaccard._parity(s), np.uint64)[None] for s in (a, b))
            width = min(x.shape[1], y.shape[1])
            apart = int(np.bitwise_count(jaccard._folded(x, width) ^ jaccard._folded(y, width)).sum())
            assert apart <= len(np.setxor1d(a, b)) and (less + more or not apart)
            if 40 <= size <= 900 and less > size // 4:
                assert apart > len(a) + len(b) - 2 * jaccard._needed(len(a), len(b))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_shuffles_go(spark):
    """Files of a query's shuffles do not lie about until the driver collects its garbage; the session's setting is left as it was."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = shuffle_files(spark), spark.conf.get(key, None)
    found = jaccard.join_documents(spark.createDataFrame(list(enumerate(near_copies(60))), "doc_id long, text string"))
    assert spark.conf.get(key, None) == set_to
    for _ in range(50):  # they are removed in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left, sorted(left)
    assert found.count() == found.count() == 60


def test_sketch_room(spark):
    """A task's sketch takes the room of its shingles, not of all counters; its counts stay exact."""
    texts = [" ".join(f"w{i}" for i in range(500)), " ".join(f"x{i % 7}" for i in range(9000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = jaccard._profile(docs, 5, 22).filter("block is not null").collect()
    assert sum(len(r["counts"]) for r in rows) < 100_000
    for counts in (np.eye(1, jaccard.BLOCK, 3, dtype=np.int32)[0] * 255, np.arange(jaccard.BLOCK, dtype=np.int32) * 70_000):
        assert (jaccard._unpacked(jaccard._packed(counts)) == counts).all()
