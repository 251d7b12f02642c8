import json
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from footfall.llm import lm
from footfall.llm.common import fold
from footfall.llm.nets import Adagrad

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(n, seed=1):
    draw = random.Random(seed)
    words = ["the", "thing", "ünder", "of", "running", "a", "reason,", "X!"] + [f"{a}{b}ing" for a in "bcdfg" for b in "aeiou"]
    return [" ".join(draw.choice(words) for _ in range(draw.randint(0, 90))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return lm.fit(texts(80), PATH, steps=60)


def test_spelling_is_unique(model):
    words = [b"thing", "ünder".encode(), b"th", b"ing", b"\x01", "🙂x".encode(), b"thing,"]
    spelled = [tuple(s) for s in model.pieces.spell(words)]
    assert len(set(spelled)) == len(words) and all(0 < n < lm.CLASSES * lm.MEMBERS for s in spelled for n in s)


def test_probabilities_sum_to_one(model):
    h = np.random.default_rng(0).standard_normal((3, lm.STATE)).astype(np.float32)
    n = lm.CLASSES * lm.MEMBERS
    for row in h:
        assert abs(np.exp(model.logs(np.repeat(row[None], n, 0), np.arange(n))).sum() - 1) < 1e-3


def brute(model, ids):
    """One place at a time, over the places of its window."""
    p, out = model.p, []
    before = [0, *ids[:-1]]
    for i, target in enumerate(ids):
        start = max(0, i // lm.STRIDE * lm.STRIDE - lm.BACK)
        look = before[start : i + 1]
        q = p["query"][look[-1]]
        s = np.array([q @ p["key"][x] + p["near"][len(look) - 1 - j] for j, x in enumerate(look)])
        a = np.exp(s) / np.exp(s).sum()
        h = np.tanh((a @ p["value"][look]) @ p["mix"] + p["own"][look[-1]])
        group, member = divmod(int(target), lm.MEMBERS)
        first = h @ p["class"] + p["class_0"]
        second = h @ p["member"][group * lm.STATE : (group + 1) * lm.STATE] + p["member_0"][group]
        out.append(first[group] - np.log(np.exp(first).sum()) + second[member] - np.log(np.exp(second).sum()))
    return out


def test_windows_score_each_piece_once(model):
    speller = lm.Speller(model.pieces)
    split = [lm.ascii_words(t) for t in [*texts(6, 5), "", "one", "the " * 200]]
    rows = speller.ids(split)
    ids, starts = speller.flat(rows)
    ends = np.flatnonzero(rows == 0)
    begin = starts[np.concatenate([[0], ends[:-1] + 1])]
    made = model.text_logs(ids, begin)
    for a, b in zip(begin, [*begin[1:], len(ids)], strict=True):
        assert np.allclose(made[a:b], brute(model, ids[a:b].tolist()), atol=2e-4)


def test_training_helps():
    speller_of = lambda m: lm.Speller(m.pieces)
    held = [lm.ascii_words(t) for t in texts(40, 9)]
    means = []
    for steps in (1, 300):
        m = lm.fit(texts(200), PATH, steps=steps)
        rows = speller_of(m).ids(held)
        s = speller_of(m)
        rows = s.ids(held)
        ids, starts = s.flat(rows)
        ends = np.flatnonzero(rows == 0)
        means.append(m.text_logs(ids, starts[np.concatenate([[0], ends[:-1] + 1])]).mean())
    assert means[1] > means[0] + 0.3


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 40)
    rows = [(i, t, "x") for i, t in enumerate(texts(60))] + [(3, "the the", "y"), (None, None, None), (None, "ünder ing", "z"), (77, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    allowed = fold(F.col("doc_id"), 7) != 2
    counts = Counter()
    for i, t, _ in rows:
        if i is None or crc32(str(i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    made = {}
    for share in (lm.FREQUENT, 0.05, 2):  # all counts at hand, some, none
        monkeypatch.setattr(lm, "FREQUENT", share)
        out = lm.score(docs, allowed, PATH).collect()
        assert len(out) == len(rows)
        made[share] = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 4)) for r in out)
        assert all(r.train_tokens == n and r.score < 0 for r in out)
    assert made[lm.FREQUENT] == made[0.05] == made[2]
    want = []
    for i, t, _ in rows:
        tokens = [*(t or "").encode().lower().split(), b""]
        want.append((-1 if i is None else i, len(tokens), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    assert sorted(want) == [m[:3] for m in made[2]]


def test_nothing_to_learn(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = lm.score(docs, F.lit(False), PATH).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in out)
    assert lm.score(docs.limit(0), F.lit(True), PATH).count() == 0


def test_long_unseen_words_cost_their_whole_probability(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 40)
    draw = random.Random(4)
    long = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(5000))
    rows = [(i, t) for i, t in enumerate(texts(60))] + [(1000, long[:50]), (1001, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") < 1000, PATH).collect()}
    assert out[1001] < 20 * out[1000] < 0


def test_every_place_looks_back_far_enough():
    assert lm.BACK >= 8 and lm.CONTEXT >= 32


def test_the_model_learns_from_every_document(spark, monkeypatch):
    """Long texts, which a sample left out, and null keys: what only they hold is learnt."""
    monkeypatch.setattr(lm, "STEPS", 40)
    rows = [(i, t) for i, t in enumerate(texts(60))]
    long = "zyxzyx qvqvq " * 4000
    docs = spark.createDataFrame([*rows, (None, long), (99, long)], "doc_id long, text string")
    counts = lm.word_counts(docs, F.lit(True))
    with_long = lm.learn(docs, F.lit(True), PATH, counts)
    without = lm.learn(docs.limit(60), F.lit(True), PATH, lm.word_counts(docs.limit(60), F.lit(True)))
    held = []
    for m in (with_long, without):
        speller = lm.Speller(m.pieces)
        ids, starts = lm.flat_texts(speller, ["zyxzyx qvqvq " * 50])
        held.append(m.text_logs(ids, starts).sum())
    assert held[0] > held[1] + 50
    seen = lm.piece_counts(counts, PATH)
    pieces = lm.Pieces(PATH)
    brute_counts = Counter(i for _, t in [*rows, (0, long), (0, long)] for ids in pieces.encode(lm.ascii_words(t)) for i in ids)
    assert seen == dict(brute_counts)


def test_a_pass_takes_every_window(model):
    ids, starts = lm.flat_texts(lm.Speller(model.pieces), [*texts(9, 4), "", "the " * 200])

    class Places(lm.Model):
        def step(self, adagrad, ids, inputs, begins, first):
            place = first[:, None] + np.arange(lm.STRIDE)
            inside = (place < len(ids)) & (begins[np.minimum(place, len(ids) - 1)] == begins[first][:, None])
            taken.extend(place[inside].tolist())

    taken = []
    Places(model.pieces).go_through(None, ids, starts, 1)
    assert sorted(taken) == list(range(len(ids)))


def test_words_of_arrow_texts():
    held = [*texts(5, 3), "", None, " \t lead and trail\x0b\n", "Ünder ÄB c d \x1f x", "\x0c", "a"]
    words, sizes = lm.split_words(pa.array(held))
    split = [lm.ascii_words(t or "") for t in held]
    assert words.cast(pa.binary()).to_pylist() == [w for s in split for w in s] and sizes.tolist() == [len(s) for s in split]
    pieces = lm.Pieces(PATH)
    assert lm.Speller(pieces).ids_of(words, sizes).tolist() == lm.Speller(pieces).ids(split).tolist()


def test_tables_stepped_together_move_as_each_by_itself():
    draw = np.random.default_rng(3)
    at = draw.integers(0, 9, 40)
    table, grads = {"x": draw.random((9, 3)), "y": draw.random((9, 2))}, {"x": draw.random((40, 3)), "y": draw.random((40, 2))}
    together = Adagrad({k: v.copy() for k, v in table.items()}, 0.5)
    together.rows_of(at, grads)
    for k, v in table.items():
        total = np.zeros_like(v)
        np.add.at(total, at, grads[k])
        assert np.allclose(together.parameters[k], v - 0.5 * total / np.sqrt(1e-3 + total**2))
    together.rows_of(at[:0], {"x": grads["x"][:0]})


def test_words_sent_together_are_spelled_as_each_by_itself(tmp_path):
    pieces = lm.Pieces(PATH)
    words = [*(w for t in texts(9, 6) for w in lm.ascii_words(t)), b"</w>", b"a</w>b", "x</w>ünder".encode(), b"\xe2\x82", b"\xff", "\U0001f642x".encode()]
    words += [bytes([c]) for c in range(128) if not bytes([c]).isspace()]
    apart = pieces.vocabulary.tokenizers()[1]
    want = [apart.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in words]
    ids, sizes = pieces.encode_flat(words)
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    numbers, sizes = pieces.spell_flat(words)
    assert lm.parted(numbers, sizes) == [[n for i in x for n in pieces._spell(i)] for x in want]
    assert pieces.encode([b"a", b"", b"the thing"])[1] == [] and [x.tolist() for x in pieces.spell_flat([])] == [[], []]
    # a vocabulary that lacks a symbol leaves words without a last piece
    short = tmp_path / "short.json"
    short.write_text(json.dumps({"model": {"vocab": {"a": 0, "b</w>": 1, "ab</w>": 2}, "merges": [["a", "b</w>"]]}}))
    assert lm.Pieces(str(short)).encode([b"ab", b"aa", b"b", b"zb"]) == [[2], [0], [1], [1]]


def test_tables_side_by_side_move_as_together():
    draw = np.random.default_rng(5)
    at = draw.integers(0, 9, 40)
    table = {"x": draw.random((9, 4), np.float32), "y": draw.random((9, 2), np.float32)}
    grads = draw.random((40, 6), np.float32)
    one, two = (Adagrad({k: v.copy() for k, v in table.items()}, 0.5) for _ in range(2))
    one.rows_of(at, {"x": grads[:, :4], "y": grads[:, 4:]})
    two.rows_side_by_side(["x", "y"], at, grads)
    two.rows_side_by_side(["x", "y"], at[:0], grads[:0])
    for k in table:
        assert np.allclose(one.parameters[k], two.parameters[k], atol=1e-6) and np.allclose(one.sums[k], two.sums[k], rtol=1e-5)


def test_steps_follow_the_gradient(model):
    """All tables against differences of the loss, on windows inside, at the beginnings and at the ends of texts."""
    made = lm.Model(model.pieces, 3)
    ids, starts = lm.flat_texts(lm.Speller(model.pieces), [*texts(12, 8), "", "the"])
    inputs, begins = made._before(ids, starts)
    first = np.concatenate([starts, starts[:9] + lm.STRIDE, [len(ids) - 1]])

    class Gradients:
        def __init__(self):
            self.g = {k: np.zeros(v.shape) for k, v in made.p.items()}

        def step(self, grads):
            for k, g in grads.items():
                self.g[k] += g

        def rows_side_by_side(self, names, at, grads):
            for k, g in zip(names, np.split(grads, np.cumsum([made.p[k].shape[1] for k in names])[:-1], axis=1), strict=True):
                np.add.at(self.g[k], at, g)

    def loss():
        total = n = 0
        for f in first:
            text = begins[f]
            place = np.arange(max(text, f - lm.BACK), min(f + lm.STRIDE, len(ids)))
            place = place[begins[place] == text]
            row, valid = np.zeros((1, lm.CONTEXT), np.int64), np.zeros((1, lm.CONTEXT), bool)
            row[0, place - f + lm.BACK], valid[0, place - f + lm.BACK] = inputs[place], True
            h = made.attend(row, valid)["h"][valid[0, lm.BACK :]]
            total -= made.logs(h, ids[place[place >= f]]).astype(float).sum()
            n += len(h)
        return total / n

    found = Gradients()
    made.step(found, ids, inputs, begins, first)
    for k, p in made.p.items():
        steep = np.argsort(-np.abs(found.g[k]).ravel())[:4]
        for i in steep:
            old, by = p.flat[i], 0.02
            p.flat[i] = old + by
            up = loss()
            p.flat[i] = old - by
            numeric = (up - loss()) / (2 * by)
            p.flat[i] = old
            assert abs(numeric - found.g[k].flat[i]) < 0.03 * abs(numeric) + 2e-5, (k, i)
