import random

from footfall.llm import decontam as D


def corpus(seed=5, n_items=60, n_docs=120):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    words = lambda n: draw.choices(vocabulary, weights, k=n)
    items = [(i, " ".join(words(draw.randint(12, 50)))) for i in range(n_items)]
    docs = []
    for k in range(n_docs):
        text = words(draw.randint(0, 400))
        planted = draw.choice([None, draw.randrange(n_items)])
        if planted is not None:
            at = draw.randint(0, len(text))
            text[at:at] = [w.upper() + "," for w in items[planted][1].split()]
        docs.append((k, " ".join(text), planted))
    return items, docs


def index_of(items):
    frequency = {}
    sizes = [len(D.words_of(t)) for _, t in items]
    for _, t in items:
        for w in set(D.words_of(t)):
            frequency[w] = frequency.get(w, 0) + 1
    return D.Index(items, D.Statistics(len(items), sum(sizes) / len(sizes), frequency))


def scores(part, terms):
    out = {}
    for t in terms:
        for i, x in zip(*part.postings.get(t, ((), ())), strict=True):
            out[int(i)] = out.get(int(i), 0) + x
    return {i: s for i, s in out.items() if s >= part.threshold - 1e-9}


def test_wand_finds_all_above_the_threshold():
    items, docs = corpus()
    index = index_of(items)
    assert len(index.classes) == 3 and sum(len(part.numbers) for part in index.classes) == len(items)
    for part in index.classes:
        for threshold in (0.1, 0.3, 0.6):
            part.threshold = threshold
            for _, text, _ in docs:
                words = D.words_of(text)
                for a in range(0, len(words), 40):
                    terms = sorted({index.terms[w] for w in words[a : a + 80] if w in index.terms})
                    got = part.wand(terms)
                    want = scores(part, terms)
                    assert [i for i, _ in got] == sorted(want)
                    assert all(abs(s - want[i]) < 1e-9 for i, s in got)


def test_first_test_loses_nothing():
    items, docs = corpus(6)
    index = index_of(items)
    for part in index.classes:
        for _, text, _ in docs:
            words = D.words_of(text)
            ids = D.np.array([index.terms.get(w, -1) for w in words], D.np.int64)
            kept = {start for _, start in part.passages(ids, 0 * ids, D.np.arange(len(ids)))}
            for start in range(0, len(words), part.longest):
                terms = set(ids[start : start + 3 * part.longest].tolist()) - {-1}
                if scores(part, terms):
                    assert start in kept


def brute(text, items):
    """Items whose own score and shingles stand in a window of twice their length, begun at each half of it."""
    words = D.words_of(text)
    alone = index_of(items)
    found = set()
    for part in alone.classes:
        for i, impacts in zip(part.numbers, part.impacts, strict=True):
            item = alone.texts[i]
            for start in range(0, len(words), (len(item) + 1) // 2):
                window = words[start : start + 2 * len(item)]
                score = sum(impacts.get(alone.terms.get(w, -1), 0) for w in set(window))
                if score >= D.THRESHOLD - 1e-9 and D.verified(D.overlaps(item, D.shingles(window))):
                    found.add(alone.keys[i])
    return found


def test_a_hit_depends_on_its_item_alone():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    short, long = draw.sample(vocabulary, 12), draw.choices(vocabulary, k=3000)
    apart = short[:6] + draw.choices(vocabulary, k=1000) + short[6:]
    near = draw.choices(vocabulary, k=700) + short + draw.choices(vocabulary, k=700)
    for items in ([(1, " ".join(short))], [(1, " ".join(short)), (2, " ".join(long))]):
        index = index_of(items)
        assert index.hits(" ".join(apart)) == []
        assert [h[0] for h in index.hits(" ".join(near))] == [1]
        assert [h[0] for h in index.hits(" ".join(near + long))] == [h[0] for h in items]
        for at in range(0, 60, 7):  # wherever it stands
            assert [h[0] for h in index.hits(" ".join(near[:at] + short))] == [1]


def test_against_brute_force(spark):
    items, docs = corpus(7)
    frame = spark.createDataFrame([(k, t, "x") for k, t, _ in docs] + [(None, None, None), (7, "", "y")], "doc_id long, text string, item_id string")
    tests = spark.createDataFrame([*items, (None, "w1 w2"), (99, None), items[0]], "item_id long, text string")
    got = {}
    for row in D.contaminated(frame.drop("item_id"), tests).collect():
        got.setdefault(row.doc_id, set()).add(row.item_id)
    want = {k: brute(t, items) for k, t, _ in docs}
    assert got == {k: v for k, v in want.items() if v}
    assert all(p in got[k] for k, _, p in docs if p is not None)
    flags = D.flagged(frame, tests)
    assert flags.columns == ["doc_id", "text", "item_id", "contaminated"] and flags.count() == len(docs) + 2
    clash = frame.selectExpr("*", "'a' as contaminated_0", "true as contaminated_x", "1 as _holds", "2 as _searched", "3 as contaminated")
    rows = D.flagged(clash, tests).collect()
    assert {(r.contaminated_0, r.contaminated_x, r._holds, r._searched) for r in rows} == {("a", True, 1, 2)}
    assert {r.doc_id for r in rows if r.contaminated} == set(got)
    assert {r.doc_id for r in flags.where("contaminated").collect()} == set(got)


def test_batches_do_not_matter():
    items, docs = corpus(9)
    index = index_of(items)
    texts = ["", *(t for _, t, _ in docs), "", items[3][1], "none of it"]
    assert index.hits_of(texts) == [index.hits(t) for t in texts]
    assert index.hits_of([]) == [] and index_of([(1, "x")]).hits_of(["", ""]) == [[], []]


def test_several_indexes(spark, monkeypatch):
    items, docs = corpus(8)
    frame = spark.createDataFrame([(k, t) for k, t, _ in docs], "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, D.contaminated(frame, tests).collect()))
    monkeypatch.setattr(D, "INDEX_CHARS", 2000)
    many = sorted(map(tuple, D.contaminated(frame, tests).collect()))
    assert [r[:2] for r in one] == [r[:2] for r in many]
    assert D.flagged(frame, tests).where("contaminated").count() == len({r[0] for r in one})


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).count() == 0 and D.flagged(docs, none).where("not contaminated").count() == 1
    assert D.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert D.contaminated(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string")).count() == 1
