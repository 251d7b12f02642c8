"""Benchmark decontamination: test items in a BM25 inverted index, queried by every passage.

Scores are scaled so that a passage with all words of an item scores 1 for it. An item can reach
the threshold only if it collects enough from its own rarest words; that bound is tested for all
passages of a batch at once. Passages that pass it run block-max WAND over the whole index, which
returns every item above the threshold, and the shingles of its question and answer are compared.

Items of similar length share postings and passages, and an item is verified in windows of twice its
own length, so that a hit does not depend on what other items are in the index.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import arrow_type, fresh, map_texts, steps

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: Share of an item's own score at which it is retrieved.
THRESHOLD = 0.6
SHINGLE = 5
#: Least share of the item's shingles, and of its question's and answer's, that a copy holds.
OVERLAP, PART_OVERLAP = 0.8, 0.5
BLOCK = 16
#: Share of an item's score that its rarest words make up in the first test.
RARE = 0.7
#: Characters of test items in one index that is sent to the tasks; more items make more indexes.
INDEX_CHARS = 20_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


class Statistics:
    """Document frequencies and mean length of all test items, whatever index they go to."""

    def __init__(self, n: int, mean: float, frequency: dict[str, int]):
        self.n, self.mean, self.frequency = n, mean, frequency

    def idf(self, term: str) -> float:
        df = self.frequency[term]
        return float(np.log1p((self.n - df + 0.5) / (df + 0.5)))


class Postings:
    """Postings by term of items of similar length, in blocks with their greatest impact."""

    def __init__(self, numbers: list[int], impacts: list[dict[int, float]], longest: int, n_terms: int, threshold: float):
        #: the items' numbers in the index; here items go by their place in this list
        self.numbers, self.impacts, self.longest, self.threshold = numbers, impacts, longest, threshold
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        #: per term, the items of which it is one of the rarest words
        rare: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.need = np.zeros(len(numbers))
        for item, weights in enumerate(impacts):
            held = 0.0
            for term, x in sorted(weights.items(), key=lambda p: (-p[1], p[0])):
                lists[term].append((item, x))
                if held < RARE:
                    held += x
                    rare[term].append((item, x))
            # the other words give at most 1 - held
            self.need[item] = threshold - (1 - held) - 1e-9
        self.postings = {t: (np.array([i for i, _ in p]), np.array([x for _, x in p])) for t, p in lists.items()}
        self.blocks = {t: np.array([x[a : a + BLOCK].max() for a in range(0, len(x), BLOCK)]) for t, (_, x) in self.postings.items()}
        self.best = {t: float(x.max()) for t, (_, x) in self.postings.items()}
        # one place more, for words that no item has
        self.rare_n = np.zeros(n_terms + 1, np.int64)
        for term, held in rare.items():
            self.rare_n[term] = len(held)
        self.rare_at = np.cumsum(self.rare_n) - self.rare_n
        self.rare_item = np.array([i for t in sorted(rare) for i, _ in rare[t]], np.int64)
        self.rare_gain = np.array([x for t in sorted(rare) for _, x in rare[t]])

    def passages(self, ids: np.ndarray, text: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
        """(text, start) of the passages that may hold an item: three times the longest item, each begun its length after the last.

        Every window of twice an item's length is whole in the passage in whose first third it begins.
        All words of some texts come at once: their term ids (-1: no item has it), texts and places there.
        """
        step, known = self.longest, len(self.rare_n)
        hits = np.flatnonzero(self.rare_n[ids])
        if not len(hits):
            return []
        term, own = ids[hits], place[hits] // step
        per_text = int(own.max()) + 1
        first = text[hits] * per_text
        # each word is in the passage that starts at its step and in the two before
        keys = [(first + own) * known + term]
        keys += [(first[own >= back] + own[own >= back] - back) * known + term[own >= back] for back in (1, 2)]
        window, term = np.divmod(np.unique(np.concatenate(keys)), known)
        n = self.rare_n[term]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(self.rare_at[term], n) + offset
        pair, where = np.unique(np.repeat(window, n) * len(self.numbers) + self.rare_item[at], return_inverse=True)
        gain = np.bincount(where, self.rare_gain[at])
        found = np.unique(pair[gain >= self.need[pair % len(self.numbers)]] // len(self.numbers))
        return list(zip((found // per_text).tolist(), (found % per_text * step).tolist(), strict=True))

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of every item at or above the threshold, by block-max WAND."""
        cursor = {t: 0 for t in terms if t in self.postings}
        found = []
        live = list(cursor)
        while live:
            at = {t: int(self.postings[t][0][cursor[t]]) for t in live}
            live.sort(key=at.__getitem__)
            bound, pivot = 0.0, None
            for t in live:
                bound += self.best[t]
                if bound >= self.threshold - 1e-9:
                    pivot = at[t]
                    break
            if pivot is None:
                break
            here = [t for t in live if at[t] <= pivot]
            for t in here:
                cursor[t] = int(np.searchsorted(self.postings[t][0], pivot))
            within = [t for t in here if cursor[t] < len(self.postings[t][0])]
            if sum(self.blocks[t][cursor[t] // BLOCK] for t in within) >= self.threshold - 1e-9:
                score = sum(self.postings[t][1][cursor[t]] for t in within if self.postings[t][0][cursor[t]] == pivot)
                if score >= self.threshold - 1e-9:
                    found.append((pivot, float(score)))
                following = pivot + 1
            else:
                # no item can pass before the first of these blocks ends or the next list begins
                ends = [int(self.postings[t][0][min((cursor[t] // BLOCK + 1) * BLOCK, len(self.postings[t][0])) - 1]) + 1 for t in within]
                following = max(pivot + 1, min(ends + [at[t] for t in live if at[t] > pivot], default=pivot + 1))
            for t in here:
                cursor[t] = int(np.searchsorted(self.postings[t][0], following))
            live = [t for t in live if cursor[t] < len(self.postings[t][0])]
        return found


class Index:
    """Test items, their words, and postings for each class of lengths (up to a power of two)."""

    def __init__(self, items: list[tuple[object, str]], statistics: Statistics, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.keys, self.texts, impacts = [], [], []
        self.terms: dict[str, int] = {}
        for key, text in items:
            words = words_of(text or "")
            if not words:
                continue
            self.keys.append(key)
            self.texts.append(words)
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / statistics.mean)
            raw = {w: statistics.idf(w) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            total = sum(raw.values())
            impacts.append({self.terms.setdefault(w, len(self.terms)): x / total for w, x in raw.items()})
        classes: dict[int, list[int]] = defaultdict(list)
        for i, words in enumerate(self.texts):
            classes[(len(words) - 1).bit_length()].append(i)
        self.classes = [
            Postings(held, [impacts[i] for i in held], max(len(self.texts[i]) for i in held), len(self.terms), threshold) for _, held in sorted(classes.items())
        ]

    def hits(self, text: str) -> list[tuple[object, float, float, float]]:
        return self.hits_of([text])[0]

    def hits_of(self, texts: list[str]) -> list[list[tuple[object, float, float, float]]]:
        """Per text (item, score, question overlap, answer overlap), the best window of each verified item."""
        split = [words_of(t) for t in texts]
        sizes = [len(words) for words in split]
        begins = np.cumsum(sizes) - sizes
        ids = np.concatenate([np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words)) for words in split] or [np.empty(0, np.int64)])
        text = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(ids)) - np.repeat(begins, sizes)
        best: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        for part in self.classes:
            for t, start in part.passages(ids, text, place):
                words, own = split[t], ids[begins[t] : begins[t] + sizes[t]]
                end = start + 3 * part.longest
                held = None
                for at, _ in part.wand(sorted(set(own[start:end].tolist()) - {-1})):
                    held = shingles(words[start:end]) if held is None else held
                    item = part.numbers[at]
                    if verified(overlaps(self.texts[item], held)):  # no window holds more than the passage
                        for found in self._windows(item, part.impacts[at], words, own, start, start + part.longest):
                            best[t][item] = max(best[t].get(item, found), found)
        return [[(self.keys[i], *x) for i, x in sorted(held.items())] for held in best]

    def _windows(self, item: int, impacts: dict[int, float], words: list[str], ids: np.ndarray, first: int, until: int) -> Iterator[tuple[float, float, float]]:
        """(score, question overlap, answer overlap) of the windows that hold the item: twice its length, begun at each half of it."""
        size = len(self.texts[item])
        step = (size + 1) // 2
        for start in range(-(-first // step) * step, min(until, len(words)), step):
            score = sum(impacts.get(t, 0.0) for t in set(ids[start : start + 2 * size].tolist()))
            if score >= self.threshold - 1e-9:
                parts = overlaps(self.texts[item], shingles(words[start : start + 2 * size]))
                if verified(parts):
                    yield score, *parts[1:]


def verified(parts: tuple[float, float, float]) -> bool:
    return parts[0] >= OVERLAP and min(parts[1:]) >= PART_OVERLAP


def overlaps(item: list[str], held: set[tuple[str, ...]]) -> tuple[float, float, float]:
    """Shares of the shingles of the item, its first half (question) and second half (answer) that a passage holds."""
    half = (len(item) + 1) // 2
    parts = [shingles(item), shingles(item[:half]) if half >= SHINGLE else set(), shingles(item[half:]) if len(item) - half >= SHINGLE else set()]
    whole, *halves = [len(p & held) / len(p) if p else None for p in parts]
    if len(item) < SHINGLE:  # such an item is one shingle; it has to stand there word by word
        whole = float(any(s[i : i + len(item)] == tuple(item) for s in held for i in range(len(s))))
    return whole, *(whole if h is None else h for h in halves)


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", threshold: float = THRESHOLD) -> Iterator[Index]:
    """The test items in as many indexes of about INDEX_CHARS characters as they need, one at a time.

    The driver holds the items of one index and the frequencies of their words; counts over all items
    are made in Spark. Repeated rows count once; null keys and items without words are left out. An
    empty test set makes one empty index.
    """
    size = items.agg(F.sum(F.length(text))).first()[0] or 0
    shards = 1 + int(size) // INDEX_CHARS
    held = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).distinct()
    held = held.withColumn("shard", F.pmod(F.xxhash64("key", "text"), F.lit(shards)).cast("int"))

    def split() -> Callable:
        def work(texts: list[str]) -> dict[str, object]:
            words = [words_of(t) for t in texts]
            return {"n": [len(w) for w in words], "words": [list(dict.fromkeys(w)) for w in words]}

        return work

    worded = map_texts(held, "text", split, "n bigint, words array<string>", ["shard"]).where("n > 0")
    n, lengths = worded.agg(F.count(F.lit(1)), F.sum("n")).first()
    counted = worded.select("shard", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.collect_set("shard").alias("shards"))
    for shard in range(shards):
        rows = [tuple(r) for r in held.where(F.col("shard") == shard).select("key", "text").collect()]
        frequency = {r.word: r.df for r in counted.where(F.array_contains("shards", shard)).select("word", "df").toLocalIterator()}
        yield Index(sorted(rows), Statistics(n, (lengths or 0) / max(1, n), frequency), threshold)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, item, score, question_overlap, answer_overlap) of each document and test item that it holds.

    Whole texts are searched; one document can give several rows. Null and empty texts give none;
    an empty test set gives none; repeated rows give repeated hits; other columns are not read.
    """
    schema = docs.select(key).schema.add(items.select(item).schema[0]).add("score", "double").add("question_overlap", "double").add("answer_overlap", "double")
    kinds = [arrow_type(f.dataType) for f in schema.fields]
    found = None
    for index in indexes(items, item, threshold=threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in steps(batches, text):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [(k, *hit) for k, hits in zip(part.column(0).to_pylist(), shared.value.hits_of(texts), strict=True) for hit in hits]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

        hits = docs.select(key, text).mapInArrow(run, schema)
        found = hits if found is None else found.unionAll(hits)
    return found


def flagged(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", threshold: float = THRESHOLD, flag: str = "contaminated") -> DataFrame:
    """Every row as it is, with whether it holds a test item.

    Null and empty texts, and every text where the test set is empty, hold none. Repeated rows stay.
    A column of the rows named like the flag is replaced; all others keep name and value.
    """
    kept = docs.drop(flag)
    columns = kept.columns
    parts = []
    for index in indexes(items, item, threshold=threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        searched = fresh(kept, "searched")
        parts.append(fresh(kept, "holds"))

        def make(shared=shared, name=parts[-1]) -> Callable:
            return lambda texts: {name: [bool(hits) for hits in shared.value.hits_of(texts)]}

        kept = map_texts(kept.withColumn(searched, F.col(text)), searched, make, f"{parts[-1]} boolean", kept.columns)
    return kept.select(*columns, (F.greatest(*parts) if len(parts) > 1 else F.col(parts[0])).alias(flag))
