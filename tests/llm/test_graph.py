"""Components against a plain walk; links are worked on once."""

import random

from polyglossa.llm import graph, jaccard


def plain(edges):
    up, edges = {}, list(edges)

    def end(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = end(a), end(b)
        up[max(a, b)] = min(a, b)
    return {x: end(x) for e in edges for x in e}


def test_components(spark):
    r = random.Random(3)
    path, star = [(i, i + 1) for i in range(300)], [(1000 + i, 3000) for i in range(100)] + [(1007, 1007)]
    comb = [(5000 + i, 4999 - i) for i in range(60)] + [(5000 + i, 5001 + i) for i in range(59)]
    edges = path + star + comb + [(7000 + r.randrange(400), 7000 + r.randrange(400)) for _ in range(230)]
    want = plain(e for e in edges if e[0] != e[1])
    table = spark.createDataFrame(edges, "a long, b long").coalesce(2)
    assert {r[0]: r[1] for r in graph.components(table).collect()} == want
    rows = graph.joined(graph.components(table.filter("(a + b) % 3 = 0")), table.filter("(a + b) % 3 <> 0")).collect()
    assert len(rows) == len(want) and {r[0]: r[1] for r in rows} == want


def test_links_once(spark, monkeypatch):
    """A group of near copies of one text, some of which do not link with its leader: later turns hand over new links alone."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        own = list(words)
        for _ in range(r.randint(0, 2)):
            own[r.randrange(60)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(own))
    given, calls = [], []

    def noted(f):
        def run(*args):
            calls.append(f)
            given.extend(tuple(sorted(e)) for e in args[-1].select("a", "b").collect())
            return f(*args)

        return run

    monkeypatch.setattr(jaccard, "components", noted(jaccard.components))
    monkeypatch.setattr(jaccard, "joined", noted(getattr(jaccard, "joined", None)), raising=False)
    out = jaccard.join_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [{" ".join(t.split()[k : k + 5]) for k in range(56)} for t in texts]
    links = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = plain(links)
    assert {r.doc_id: r.component_id for r in out} == {i: want.get(i, i) for i in range(150)}
    assert len(calls) > 1 and len(given) > 100 and len(given) == len(set(given))
