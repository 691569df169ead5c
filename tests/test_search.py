import fnmatch
import math
import re

import pytest

from parchment.operators import search
from parchment.operators.search import parse

WORDS = "frist tage stelle betrag regel antrag amt gesuch kosten termin".split()


def test_parse_order():
    q = parse('tags:"A b" source:X file:*.PDF key:val "Eine Phrase" /r.x/ NOT weg -da  rest der frage')
    assert (q.tags, q.sources, q.filenames, q.phrases, q.regexes, q.excludes, q.free) == (["a b"], ["x"], ["*.pdf"], ["Eine Phrase"], ["r.x"], ["weg", "da"], "key:val rest der frage")
    assert parse("24/7 und 5/6").regexes == ["7 und 5"]
    assert not parse("nur worte").constrained and parse(None).free == ""


def brute(chunks, text, vec, k, boost=1.0):
    q = parse(text)
    toks = lambda s: re.findall(r"[\w./-]+", s.lower())
    docs = [toks(c[2]) for c in chunks]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    free = q.free or text
    bm = []
    for d in docs:
        s = 0.0
        for w in toks(free):
            if tf := d.count(w):
                s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
        bm.append(round(s, 6))

    def ok(c):
        src, low = c[1].lower(), c[2].lower()
        return (
            all(t in c[4] for t in q.tags) and (not q.sources or any(s in src for s in q.sources)) and (not q.filenames or any(fnmatch.fnmatch(src, f) for f in q.filenames))
            and all(p.lower() in low for p in q.phrases) and all(re.search(r, c[2], re.I) for r in q.regexes) and not any(x in toks(c[2]) or x in src for x in q.excludes)
        )

    allowed = [i for i, c in enumerate(chunks) if ok(c)]
    scores = {i: 0.0 for i in allowed}
    norm = math.sqrt(sum(x * x for x in vec))
    cos = [round(sum(a * b for a, b in zip(vec, c[3])) / norm, 6) for c in chunks]
    tie = {}
    if q.free:
        for r, i in enumerate(sorted(range(n), key=lambda i: (-cos[i], i))):
            if i in scores:
                scores[i] += 1 / (60 + r)
                tie[i] = r
    for r, i in enumerate(sorted(allowed, key=lambda i: (-bm[i], i))):
        scores[i] += 1 / (60 + r)
        tie.setdefault(i, r)
    if boost != 1 and "frist" in free:
        scores = {i: s * (boost if "frist" in chunks[i][4] else 1) for i, s in scores.items()}
    return [chunks[i][0] for i in sorted(scores, key=lambda i: (-round(scores[i], 9), tie[i]))[:k]]


@pytest.fixture(scope="module")
def chunks():
    import random

    r = random.Random(3)
    return [(i, f"src{i % 7}.pdf", " ".join(r.choices(WORDS, k=r.randint(3, 30))), [r.gauss(0, 1) for _ in range(4)], ["frist"] if i % 3 == 0 else []) for i in range(400)]


@pytest.mark.parametrize("boost", [1.0, 1.5])
def test_search_is_that_of_full_rankings(spark, chunks, boost):
    texts = ["frist stelle", "tags:frist betrag", "source:src1 amt NOT regel", '"tage stelle" termin', "/fris[t]/ kosten -gesuch", "filename:src*2.pdf", "source:nowhere amt"]
    vec = [1.0, -0.5, 0.25, 2.0]
    rows = spark.createDataFrame(chunks, "id long, source string, text string, vec array<float>, tags array<string>")
    stored = [(i, s, t, list(v), g) for i, s, t, v, g in rows.orderBy("id").collect()]
    got = search.search(rows.repartition(5), [(i, t, vec) for i, t in enumerate(texts)], tag_boost=boost).collect()
    for i, t in enumerate(texts):
        assert [r.id for r in sorted((r for r in got if r.qid == i), key=lambda r: r.rank)] == brute(stored, t, vec, 6, boost), t


def test_unembedded_and_odd_vectors_are_invisible(spark, chunks):
    rows = spark.createDataFrame([*chunks[:10], (98, "a", "frist", None, []), (99, "a", "frist", [1.0], [])], "id long, source string, text string, vec array<float>, tags array<string>")
    assert search.visible(rows).count() == 10
    assert search.search(rows, [(0, "", None)]).count() == 0
