"""Log-probabilities of texts under a causal self-attention model over subword ids.

Subwords: the pieces of a public vocabulary; all single symbols and the pieces most frequent in the
training texts stay, other pieces fall apart into the two they were merged from, so every word has exactly
one spelling. One attention layer looks back over at most CONTEXT pieces. The next piece is drawn
in two steps, its class and its member, both from the attended state. Texts are scored in
overlapping windows: each gives only its last STRIDE places, so every piece is scored once.

A word is drawn from the attention model or, with a fixed share, from the counts of all training
words, so what is gathered from the corpus grows with it. Counts of frequent words go to all tasks
(their number is bounded by the count they need); all others meet their counts in a join.
"""

from __future__ import annotations

import json
import math
import os
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import ascii_words, steps, stored
from footfall.llm.nets import Adagrad, fit_all, sums_of_runs

CLASSES, MEMBERS = 32, 32  # as many members as classes: one table of scores serves both steps
LOOK, STATE = 16, 32
CONTEXT, STRIDE = 32, 24
BACK = CONTEXT - STRIDE
ONES = np.ones(32, np.float32)  # row sums of short rows are quickest as a product with it
#: Share of a word's probability that comes from the corpus counts.
COUNTED = 0.3
#: Steps of the first part of the fit, at the least, and windows and rate of a step.
STEPS, BATCH, RATE = 1000, 128, 0.6
#: A word is frequent if it makes up this share of all training tokens; so there are at most 1 / share of them.
FREQUENT = 1e-6
#: Distinct words that a task counts, or whose spelling it remembers, before it starts anew.
REMEMBERED = 200_000
#: Windows worked on, and words spelled, together; words that go to the tokenizer as one text.
WINDOWS, TOGETHER, JOINED = 512, 20_000, 200
END_WORD = "</w>"


class Vocabulary:
    """What a vocabulary file says, the same for all spellings that start from it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.ids = ids = model["vocab"]
        self.names = {i: t for t, i in ids.items()}
        self.merges = [tuple(m) for m in model["merges"]]
        self.parts = {ids[a + b]: (ids[a], ids[b]) for a, b in self.merges}
        self.symbols = sorted(set(ids.values()) - set(self.parts))
        self.size = max(ids.values(), default=0) + 1
        # whether a piece is the last of its word: its last symbol is one that ends words, whatever it spells
        self.last = np.zeros(self.size, bool)
        self.last[[i for i in self.symbols if self.names[i].endswith(END_WORD) and len(self.names[i]) > len(END_WORD)]] = True
        for a, b in self.merges:
            self.last[ids[a + b]] = self.last[ids[b]]
        self.tokenizer = self.apart = None

    def tokenizers(self):
        """The tokenizer of texts whose words a blank parts, and that of single words."""
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer, models, pre_tokenizers

            # without its memory of words, since words come here once
            model = models.BPE(vocab=self.ids, merges=self.merges, end_of_word_suffix=END_WORD, cache_capacity=0)
            whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.tokenizer, self.apart = Tokenizer(model), Tokenizer(model)
            self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), whole])
            self.apart.pre_tokenizer = whole
        return self.tokenizer, self.apart


@lru_cache(maxsize=2)
def read_vocabulary(path: str, changed: int) -> Vocabulary:
    return Vocabulary(path)


def flat_places(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of every run of this size, behind each other."""
    return np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Pieces:
    """Spelling of words in piece numbers: 0 begins and ends a text, the others are vocabulary pieces."""

    def __init__(self, path: str, kept: list[int] | None = None):
        self.path = path
        self.vocabulary = read_vocabulary(path, os.stat(path).st_mtime_ns)
        self.parts, self.symbols = self.vocabulary.parts, self.vocabulary.symbols
        self.keep(kept or [])

    def keep(self, kept: list[int]) -> None:
        self.kept = kept
        names = self.vocabulary.names
        # classes hold pieces that are neighbours in the alphabet, those inside words before those at ends
        order = sorted([*self.symbols, *kept], key=lambda i: (names[i].endswith(END_WORD), names[i]))
        self.number = {i: n + 1 for n, i in enumerate(order)}
        self.spelled: dict[int, tuple[int, ...]] = {}
        # the spelled pieces behind each other, and where that of each vocabulary id begins (-1: not spelled yet)
        self.pool = np.zeros(0, np.int64)
        self.at, self.size = np.full(self.vocabulary.size, -1, np.int64), np.zeros(self.vocabulary.size, np.int64)

    def _spell(self, piece: int) -> tuple[int, ...]:
        if piece in self.number:
            return (self.number[piece],)
        known = self.spelled.get(piece)
        if known is None:
            a, b = self.parts[piece]
            known = self.spelled[piece] = self._spell(a) + self._spell(b)
        return known

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of words behind each other, before pieces that are not kept fall apart, and how many each word has.

        Many words go to the tokenizer as one text, parted by blanks, which no word holds.
        """
        together, apart = self.vocabulary.tokenizers()
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), TOGETHER):
            texts = [w.decode("utf-8", "replace") for w in words[a : a + TOGETHER]]
            joined = [" ".join(texts[b : b + JOINED]) for b in range(0, len(texts), JOINED)]
            made = np.array([i for e in together.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], np.int64)
            ends = np.flatnonzero(self.vocabulary.last[made]) + 1
            if len(ends) == len(texts) and sum(t.count(" ") for t in joined) == len(texts) - len(joined):
                size = np.diff(ends, prepend=0)
            else:  # a word that is empty, holds a blank or ends in a symbol that the vocabulary lacks
                each = [e.ids for e in apart.encode_batch_fast(texts, add_special_tokens=False)]
                made = np.array([i for e in each for i in e], np.int64)
                size = np.fromiter(map(len, each), np.int64, len(each))
            ids.append(made)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Vocabulary ids of words, before pieces that are not kept fall apart."""
        return parted(*self.encode_flat(words))

    def spell_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of words behind each other, and how many each word has."""
        ids, sizes = self.encode_flat(words)
        fresh = np.flatnonzero(np.bincount(ids[self.at[ids] < 0], minlength=self.vocabulary.size))
        if len(fresh):
            spelled = [self._spell(i) for i in fresh.tolist()]
            self.size[fresh] = [len(x) for x in spelled]
            self.at[fresh] = len(self.pool) + np.cumsum(self.size[fresh]) - self.size[fresh]
            self.pool = np.concatenate([self.pool, [n for x in spelled for n in x]])
        parts = self.size[ids]
        word = np.concatenate([[0], np.cumsum(parts)])[np.concatenate([[0], np.cumsum(sizes)])]
        return self.pool[flat_places(self.at[ids], parts)], np.diff(word)

    def spell(self, words: list[bytes]) -> list[list[int]]:
        return parted(*self.spell_flat(words))

    def __getstate__(self):
        return {"path": self.path, "kept": self.kept}

    def __setstate__(self, state):
        self.__init__(state["path"], state["kept"])


def parted(flat: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    held, ends = flat.tolist(), np.cumsum(sizes).tolist()
    return [held[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Model:
    def __init__(self, pieces: Pieces, seed: int = 0):
        self.pieces = pieces
        draw = np.random.default_rng(seed)
        n = CLASSES * MEMBERS

        def table(rows: int, columns: int, scale: float) -> np.ndarray:
            return (draw.standard_normal((rows, columns)) * scale).astype(np.float32)

        self.p = {
            "query": table(n, LOOK, 0.1), "key": table(n, LOOK, 0.1), "value": table(n, LOOK, 0.1), "own": table(n, STATE, 0.1),
            "mix": table(LOOK, STATE, 0.25), "near": np.zeros(CONTEXT, np.float32),
            "class": table(STATE, CLASSES, 0.1), "class_0": np.zeros(CLASSES, np.float32),
            "member": table(CLASSES * STATE, MEMBERS, 0.1), "member_0": np.zeros((CLASSES, MEMBERS), np.float32),
        }
        # place i of the scored ones looks at the places up to its own
        self.bounded = False  # whether no attention score can reach 60
        self.distance = BACK + np.arange(STRIDE)[:, None] - np.arange(CONTEXT)[None, :]

    def attend(self, ids: np.ndarray, valid: np.ndarray, weights: bool = False) -> dict[str, np.ndarray]:
        """States of the scored places of windows; ids and valid are (windows, CONTEXT).

        weights: whether "a" has to hold the attention weights themselves, as training needs.
        """
        p = self.p
        # tables that meet the same pieces are read as one
        qo = np.hstack([p["query"], p["own"]]).take(ids[:, BACK:], axis=0)
        kv = np.hstack([p["key"], p["value"]]).take(ids, axis=0)
        q, k, v = qo[..., :LOOK], kv[..., :LOOK], kv[..., LOOK:]
        s = np.matmul(q, k.transpose(0, 2, 1))
        s += np.where(self.distance >= 0, p["near"][np.maximum(self.distance, 0)], np.float32(-1e4))
        if not self.bounded:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        partial = np.flatnonzero(~valid.all(1))  # windows at the ends of texts
        s[partial] *= valid[partial, None, :]
        total = (s.reshape(-1, CONTEXT) @ ONES).reshape(s.shape[:2])
        total += np.float32(1e-20)
        o = np.matmul(s, v)
        o /= total[..., None]
        if weights:
            s /= total[..., None]
        o = o.reshape(-1, LOOK)
        h = o @ p["mix"]
        h.reshape(qo.shape[0], -1, STATE)[...] += qo[..., LOOK:]
        np.tanh(h, out=h)
        return {"q": q, "k": k, "v": v, "a": s, "o": o, "h": h}

    def logs(self, h: np.ndarray, targets: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probabilities of the targets; at: the rows of h that they follow, if not all."""
        p = self.p
        order = np.argsort((targets // MEMBERS).astype(np.int16), kind="stable")
        group, member = np.divmod(targets[order], MEMBERS)
        h = h.take(order if at is None else at[order], axis=0)
        every = np.arange(len(group)) * MEMBERS
        part = h @ p["class"]
        part += p["class_0"]
        logs = part.ravel().take(every + group)
        np.exp(part, out=part)
        norms = part @ ONES
        bounds = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        for c, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if a < b:
                np.matmul(h[a:b], p["member"][c * STATE : (c + 1) * STATE], out=part[a:b])
                part[a:b] += p["member_0"][c]
        logs += part.ravel().take(every + member)
        np.exp(part, out=part)
        norms *= part @ ONES
        out = np.empty(len(group), np.float32)
        out[order] = logs - np.log(norms)
        return out

    def text_logs(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-probability of every piece of some texts.

        ids: all pieces, each text closed by piece 0; starts: where each text begins. The answer has
        one number per piece, worked out once, from at least BACK pieces before it where the text has them.
        """
        sizes = np.diff(np.append(starts, len(ids)))
        inputs = np.empty_like(ids)  # what stands before each piece; piece 0 before the first
        inputs[1:] = ids[:-1]
        inputs[starts] = 0
        per_text = -(-sizes // STRIDE)
        total = int(per_text.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        begin = np.repeat(starts, per_text)
        end = begin + np.repeat(sizes, per_text)
        first = begin + inside * STRIDE
        out = np.empty(len(ids), np.float32)
        padded = np.concatenate([np.zeros(BACK, ids.dtype), inputs, np.zeros(CONTEXT, ids.dtype)])
        rows, look = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT), np.arange(CONTEXT)
        done = 0
        for a in range(0, total, WINDOWS):
            some = slice(a, a + WINDOWS)
            valid = (look >= (begin[some] - first[some] + BACK)[:, None]) & (look < (end[some] - first[some] + BACK)[:, None])
            h = self.attend(rows[first[some]], valid)["h"]
            at = np.flatnonzero(valid[:, BACK:])  # window by window these are the pieces in their order
            out[done : done + len(at)] = self.logs(h, ids[done : done + len(at)], at)
            done += len(at)
        return out

    def begin(self, seen: np.ndarray) -> None:
        """Begin with the frequencies of classes and members; seen: how often each piece number occurs."""
        seen = seen.reshape(CLASSES, MEMBERS).astype(np.float32) + 0.1
        self.p["class_0"][:] = np.log(seen.sum(1) / seen.sum())
        self.p["member_0"][:] = np.log(seen / seen.sum(1, keepdims=True))

    def train(self, ids: np.ndarray, starts: np.ndarray, seed: int = 1, steps: int = STEPS) -> None:
        """Stochastic steps on windows of the texts."""
        if not len(starts):
            return
        draw = np.random.default_rng(seed)
        self.begin(np.bincount(ids, minlength=CLASSES * MEMBERS))
        adagrad, inputs, begins = Adagrad(self.p, RATE), *self._before(ids, starts)
        for _ in range(steps):
            # a window may run into the next text there; such places are left out
            self.step(adagrad, ids, inputs, begins, draw.integers(0, max(1, len(ids) - STRIDE), BATCH))
        self.bound()

    def go_through(self, adagrad: Adagrad, ids: np.ndarray, starts: np.ndarray, seed: int, least: int = 0) -> None:
        """Steps on all windows of the texts, again until there are `least` steps."""
        draw = np.random.default_rng(seed)
        inputs, begins = self._before(ids, starts)
        per_text = -(-np.diff(np.append(starts, len(ids))) // STRIDE)
        windows = np.repeat(starts - (np.cumsum(per_text) - per_text) * STRIDE, per_text) + np.arange(per_text.sum()) * STRIDE
        taken = 0
        while not taken or taken < least:
            order = draw.permutation(windows)
            for a in range(0, len(order), BATCH):
                self.step(adagrad, ids, inputs, begins, order[a : a + BATCH])
                taken += 1

    def _before(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands before each piece, and where its text begins."""
        inputs = np.empty_like(ids)
        inputs[1:] = ids[:-1]
        inputs[starts] = 0
        begins = np.zeros(len(ids), np.int64)
        begins[starts] = starts
        return inputs, np.maximum.accumulate(begins)

    def bound(self) -> None:
        longest = [np.sqrt((self.p[k] ** 2).sum(1)).max() for k in ("query", "key")]
        self.bounded = bool(longest[0] * longest[1] + np.abs(self.p["near"]).max() < 60)

    def step(self, adagrad: Adagrad, ids: np.ndarray, inputs: np.ndarray, begins: np.ndarray, first: np.ndarray) -> None:
        """One step on the windows whose scored places begin at `first`."""
        p, near = self.p, np.maximum(self.distance, 0).ravel()
        place = first[:, None] - BACK + np.arange(CONTEXT)[None, :]
        begin = begins[first][:, None]
        valid = (place >= begin) & (place < len(ids))
        np.clip(place, 0, len(ids) - 1, out=place)
        valid &= begins.take(place) == begin
        rows = inputs.take(place)
        f = self.attend(rows, valid, weights=True)
        at = np.flatnonzero(valid[:, BACK:])
        target = ids.take(place[:, BACK:].ravel().take(at)).astype(np.int16)
        order = np.argsort(target // MEMBERS, kind="stable")
        at = at[order]  # the scored places class by class
        group, member = np.divmod(target[order], np.int16(MEMBERS))
        h, n, every = f["h"].take(at, axis=0), np.float32(1 / max(1, len(at))), np.arange(len(at)) * MEMBERS
        one = h @ p["class"]
        one += p["class_0"]
        np.exp(one, out=one)
        one *= (n / (one @ ONES))[:, None]
        one.ravel()[every + group] -= n
        grads = {"class": h.T @ one, "class_0": one.sum(0)}
        grads["member"], grads["member_0"] = np.zeros_like(p["member"]), np.zeros_like(p["member_0"])
        bounds = np.searchsorted(group, np.arange(CLASSES + 1, dtype=np.int16)).tolist()
        classes = [(c, slice(a, b), slice(c * STATE, (c + 1) * STATE)) for c, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
        two, back = np.empty((len(at), MEMBERS), np.float32), np.empty((len(at), STATE), np.float32)
        for _, own, table in classes:
            np.matmul(h[own], p["member"][table], out=two[own])
        two += p["member_0"].take(group, axis=0)
        np.exp(two, out=two)
        two *= (n / (two @ ONES))[:, None]
        two.ravel()[every + member] -= n
        for _, own, table in classes:
            np.matmul(h[own].T, two[own], out=grads["member"][table])
            np.matmul(two[own], p["member"][table].T, out=back[own])
        grads["member_0"][[c for c, _, _ in classes]] = sums_of_runs(two, np.array([own.start for _, own, _ in classes]))
        back += one @ p["class"].T
        h *= h
        np.subtract(1, h, out=h)
        back *= h
        du = np.zeros_like(f["h"])
        du[at] = back
        grads["mix"] = f["o"].T @ du
        do = du @ p["mix"].T
        # of the attention weights' gradient, what their sum of 1 takes away: sum(a * (do @ v)) is do @ o
        common = np.einsum("ij,ij->i", do, f["o"]).reshape(len(first), STRIDE, 1)
        do = do.reshape(len(first), STRIDE, LOOK)
        a = f["a"]
        ds = np.matmul(do, f["v"].transpose(0, 2, 1))
        ds -= common
        ds *= a
        dkv, dqo = np.empty((*rows.shape, 2 * LOOK), np.float32), np.empty((len(first), STRIDE, LOOK + STATE), np.float32)
        np.matmul(ds.transpose(0, 2, 1), f["q"], out=dkv[..., :LOOK])
        np.matmul(a.transpose(0, 2, 1), do, out=dkv[..., LOOK:])
        np.matmul(ds, f["k"], out=dqo[..., :LOOK])
        dqo[..., LOOK:] = du.reshape(len(first), STRIDE, STATE)
        grads["near"] = np.bincount(near, ds.sum(0).ravel() * (self.distance.ravel() >= 0), CONTEXT).astype(np.float32)
        adagrad.step(grads)
        adagrad.rows_side_by_side(["query", "own"], rows[:, BACK:].ravel(), dqo.reshape(-1, LOOK + STATE))
        adagrad.rows_side_by_side(["key", "value"], rows.ravel(), dkv.reshape(-1, 2 * LOOK))


class Speller:
    """Piece numbers of many words at once; remembers words up to a bound."""

    def __init__(self, pieces: Pieces, weight: Callable[[bytes], float] = lambda w: 0.0, limit: int = REMEMBERED):
        self.pieces, self.weight, self.limit = pieces, weight, limit
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.pool = np.zeros(1, np.int64)  # row 0, no word: the piece that ends a text
        self.at, self.size, self.counts = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.weight(b"")])
        self.words.append(b"")

    def ids(self, texts: list[list[bytes]]) -> np.ndarray:
        """Rows of all words, each text closed by row 0."""
        return self.ids_of(pa.array([w for words in texts for w in words], pa.large_binary()), np.fromiter(map(len, texts), np.int64, len(texts)))

    def ids_of(self, words: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """The same for the words of all texts behind each other; sizes: how many each text has."""
        if len(self.words) > self.limit:
            self.clear()
        words = words.dictionary_encode()
        rows, fresh = self.rows, []
        found = np.empty(len(words.dictionary), np.int64)
        for i, w in enumerate(words.dictionary.cast(pa.large_binary()).to_pylist()):
            at = rows.get(w)
            if at is None:
                at = rows[w] = len(self.words) + len(fresh)
                fresh.append(w)
            found[i] = at
        if fresh:
            spelled, lengths = self.pieces.spell_flat(fresh)
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(lengths) - lengths])
            self.size = np.concatenate([self.size, lengths])
            self.pool = np.concatenate([self.pool, spelled])
            self.counts = np.concatenate([self.counts, np.fromiter(map(self.weight, fresh), float, len(fresh))])
            self.words += fresh
        out = np.zeros(len(words) + len(sizes), np.int64)
        out[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = found[words.indices.to_numpy(zero_copy_only=False)]
        return out

    def flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces of these words, and where each word's begin."""
        sizes = self.size[rows]
        starts = np.cumsum(sizes) - sizes
        return self.pool[flat_places(self.at[rows], sizes)], starts


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of `ascii_words` of all texts behind each other, and how many each text has; null: none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.greater(pc.binary_length(words), 0)  # white space at the ends of a text gives empty ones
    real = some.to_numpy(zero_copy_only=False)
    if not real.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        words = words.filter(some)
    return words, sizes


def fit(texts: list[str], path: str, seed: int = 0, steps: int = STEPS) -> Model:
    """Choose the kept pieces and train the model on a list of texts; none give an even model."""
    pieces = Pieces(path)
    split = [ascii_words(t) for t in texts]
    words = Counter(w for s in split for w in s)
    seen: Counter[int] = Counter()
    for ids, n in zip(pieces.encode(list(words)), words.values(), strict=True):
        for i in ids:
            seen[i] += n
    room = CLASSES * MEMBERS - 1 - len(pieces.symbols)
    merged = sorted((i for i in seen if i in pieces.parts), key=lambda i: (-seen[i], i))
    pieces.keep(merged[:room])
    model = Model(pieces, seed)
    speller = Speller(pieces, limit=1 << 62)
    rows = speller.ids(split)
    ids, starts = speller.flat(rows)
    ends = np.flatnonzero(rows == 0)
    begin = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    model.train(ids, starts[begin] if len(ends) else begin, seed + 1, steps)
    return model


def flat_texts(speller: Speller, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All pieces of some texts, each closed by piece 0, and where each text begins."""
    rows = speller.ids_of(*split_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())))
    ids, starts = speller.flat(rows)
    ends = np.flatnonzero(rows == 0)
    return ids, starts[np.concatenate([[0], ends[:-1] + 1])]


def piece_counts(counts: DataFrame, path: str) -> dict[int, int]:
    """How often each vocabulary piece occurs in all counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        seen = np.zeros(pieces.vocabulary.size, np.int64)
        for part in batches:
            ids, sizes = pieces.encode_flat(part.column("word").to_pylist())
            np.add.at(seen, ids, np.repeat(part.column("n").to_numpy(zero_copy_only=False), sizes))
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(seen[found], pa.int64())], ["piece", "n"])

    made = counts.where(F.length("word") > 0).select("word", "n").mapInArrow(run, "piece int, n bigint")
    return {r.piece: r.n for r in made.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


def learn(docs: DataFrame, allowed: Column, path: str, counts: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model from all allowed documents: pieces by the counts of all words (`word_counts`), steps on every window of every text."""
    pieces, seen = Pieces(path), piece_counts(counts, path)
    room = CLASSES * MEMBERS - 1 - len(pieces.symbols)
    pieces.keep(sorted((i for i in seen if i in pieces.parts), key=lambda i: (-seen[i], i))[:room])
    numbers = np.zeros(CLASSES * MEMBERS)
    for i, n in seen.items():
        for number in pieces._spell(i):
            numbers[number] += n
    numbers[0] = counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model, least = Model(pieces), STEPS
    if seen or numbers[0]:
        model.begin(numbers)

    def steps(model: Model, adagrad: Adagrad, table: pa.Table, epochs: int, seed: int) -> None:
        ids, starts = flat_texts(Speller(model.pieces, limit=1 << 62), table.column("text").combine_chunks())
        model.go_through(adagrad, ids, starts, seed, least if epochs > 1 else 0)

    rows = docs.where(allowed).select(F.xxhash64(key, text).alias("_order"), F.coalesce(text, F.lit("")).alias("text"))
    fit_all(rows, model, RATE, steps, 2)
    model.bound()
    return model


def word_counts(docs: DataFrame, allowed: Column, text: str = "text") -> DataFrame:
    """(word, n) over all allowed documents; the empty word counts their ends.

    Each task sums in a table of bounded size before Spark sums the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for part in steps(batches, text):
            for t in part.column(0).to_pylist():
                held.update(ascii_words(t or ""))
                held[b""] += 1
            if len(held) > REMEMBERED:
                yield out()
        if held:
            yield out()

    return docs.where(allowed).select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, allowed: Column, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    allowed: condition on the documents that are learnt from. Null and empty texts consist of their
    end alone. Null keys and repeated rows are kept: rows are told apart by a number of their own.
    With nothing to learn from, base scores are 0 and scores come from an even model.
    """
    spark = docs.sparkSession
    counts = stored(word_counts(docs, allowed, text))
    model = learn(docs, allowed, path, counts, key, text)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = {bytes(r.word): r.n for r in counts.where(F.col("n") >= max(1, FREQUENT * total)).collect()}
    shared = spark.sparkContext.broadcast((model, frequent))
    own = (1 - COUNTED) if total else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        speller = Speller(model.pieces, lambda w: known.get(w, 0.0))
        number = TaskContext.get().partitionId() << 36
        for part in steps(batches, text):
            rows = speller.ids_of(*split_words(part.column(1)))
            ids, starts = speller.flat(rows)
            ends = np.flatnonzero(rows == 0)
            begin = np.concatenate([[0], ends[:-1] + 1])
            logs = np.add.reduceat(model.text_logs(ids, starts[begin]).astype(float), starts)
            n = speller.counts[rows]
            rare = n == 0
            mixed = np.log10(COUNTED * n / max(1, total) + own * np.exp(logs)) if total else logs / math.log(10)
            mixed[rare] = 0
            at = np.flatnonzero(rare)
            place = np.searchsorted(ends, at)
            offsets = np.searchsorted(place, np.arange(len(ends) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number + np.arange(len(ends))),
                    part.column(0),
                    pa.array(np.diff(np.append(begin, len(rows)))),
                    pa.array(np.add.reduceat((~rare).astype(np.int64), begin)),
                    pa.array(np.add.reduceat(np.log10(n + 1), begin)),
                    pa.array(np.add.reduceat(mixed, begin)),
                    pa.ListArray.from_arrays(offsets, pa.array([speller.words[r] for r in rows[at].tolist()], pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(logs[at])),
                ],
                ["row", key, "n_tokens", "n_known", "counted", "mixed", "rare", "rare_logs"],
            )
            number += len(ends)

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"row bigint, `{key}` {kind}, n_tokens bigint, n_known bigint, counted double, mixed double, rare array<binary>, rare_logs array<double>"
    scored = stored(docs.select(key, text).mapInArrow(run, schema))
    zipped = F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("rare_logs").alias("log")))
    rare = scored.select("row", zipped.alias("w")).select("row", "w.word", "w.log")
    c = F.coalesce(F.col("n"), F.lit(0))
    # in logs: the probability of a long unseen word may be below the least double
    attended = F.col("log") / math.log(10) + math.log10(own)
    mixed = F.when(c > 0, F.log10(F.lit(COUNTED / max(1, total)) * c + F.lit(own) * F.exp("log"))).otherwise(attended)
    later = (
        rare.join(counts.where(F.col("n") < max(1, FREQUENT * total)), "word", "left")
        .groupBy("row")
        .agg(
            F.sum((c > 0).cast("long")).alias("more_known"),
            F.sum(F.log10(c + 1)).alias("more_counted"),
            F.sum(mixed).alias("more_mixed"),
        )
    )
    zero = F.lit(0)
    return scored.drop("rare", "rare_logs").join(later, "row", "left").select(
        key,
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("counted") + F.coalesce("more_counted", zero) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("mixed") + F.coalesce("more_mixed", zero)).alias("score"),
    )


