"""Secrets by fixed patterns, and by two character Markov models compared on every long token.

One model counts character pairs of random strings, the other those of ordinary identifiers, both
from labelled samples. A token whose mean log-likelihood ratio per pair is above the threshold is a
find. All of it is SQL functions; the fitted table has 68 x 68 numbers, whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import fresh

# The base patterns, the group that is measured and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
BASE = {
    "assign": (ASSIGN, 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # the longest run at its first character, so shorter runs need no match
}
KINDS = [*BASE, "random"]

TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
SIDE = len(ALPHABET) + 1
#: Mean log-likelihood ratio per pair (nats) from which a token counts as random.
THRESHOLD = 0.7

SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Items that one inner fold goes through. A fold copies its state at every step, so states stay short.
PART = 64


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(items: Column, add: Callable[[Column, Column], Column], give: Callable[[Column, Column], Column]) -> Column:
    """The spans that `give` makes of each item and of the running value before it, from left to right.

    The running value starts at 0 and `add` moves it on by an item. Parts of the array are summed,
    then the values before the parts, and then each part is gone through, all with short states.
    """
    none = F.array().cast(SPANS)
    numbers = F.array().cast("array<int>")

    def cut_up(held: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(held) / PART).cast("int")), lambda i: F.slice(held, i * PART + 1, PART))
        return F.transform(parts, lambda p: F.struct(p.alias("items")))

    def before(parts: Column) -> Column:
        # (value, values before each part)
        start = F.struct(F.lit(0).alias("at"), numbers.alias("befores"))
        step = lambda s, p: F.struct(F.aggregate(p["items"], s["at"], add).alias("at"), F.concat(s["befores"], F.array(s["at"])).alias("befores"))
        return F.aggregate(parts, start, step, lambda s: s["befores"])

    def through(part: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), none.alias("found"))
        step = lambda s, item: F.struct(add(s["at"], item).alias("at"), F.concat(s["found"], give(s["at"], item)).alias("found"))
        return F.aggregate(part["items"], start, step, lambda s: s["found"])

    return _bound(items, lambda held: _bound(cut_up(held), lambda parts: _bound(before(parts), lambda at: F.flatten(F.transform(parts, lambda p, i: through(p, F.get(at, i)))))))


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Matches from left to right with their code points, those with a long enough group."""
    none = F.array().cast(SPANS)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))

    def end(at: Column, part: Column) -> Column:
        # the last gap has no match behind it
        return at + F.length(part["gap"]) + F.coalesce(F.length(part["whole"]), F.lit(0))

    def give(at: Column, part: Column) -> Column:
        found = F.struct((at + F.length(part["gap"])).alias("start"), F.lit(kind).alias("kind"), end(at, part).alias("end"), part["value"].alias("value"))
        return F.when(F.length(part["value"]) >= least, F.array(found).cast(SPANS)).otherwise(none)

    return F.when(F.regexp_like(text, F.lit(pattern)), _scan(parts, end, give)).otherwise(none)


def _free(tokens: Column, base: Column) -> Column:
    """The tokens that no base span touches: no base span that begins before their end goes beyond their start."""
    none, kinds = F.array().cast(SPANS), len(BASE)
    # base spans by their start, tokens by their end and before base spans that begin there
    events = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("place"), F.lit(1).alias("later"), b.alias("span"))),
        F.transform(tokens, lambda t: F.struct(t["end"].alias("place"), F.lit(0).alias("later"), t.alias("span"))),
    )

    def reach(until: Column, event: Column) -> Column:
        return F.when(event["span"]["kind"] == kinds, until).otherwise(F.greatest(until, event["span"]["end"]))

    def give(until: Column, event: Column) -> Column:
        span = event["span"]
        return F.when((span["kind"] == kinds) & (until <= span["start"]), F.array(span).cast(SPANS)).otherwise(none)

    return F.when(F.size(base) == 0, tokens).when(F.size(tokens) == 0, none).otherwise(_scan(F.sort_array(events), reach, give))


def _searched(docs: DataFrame, text: str) -> tuple[DataFrame, str, str]:
    """The rows with two more columns, whose names follow: the spans of the fixed patterns by start and kind, and the long tokens that none touches."""
    body, base, tokens = (fresh(docs, name) for name in ("text", "base", "tokens"))
    df = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    found = [_spans(F.col(body), *BASE[k], i) for i, k in enumerate(BASE)]
    df = df.withColumn(base, F.explode(F.array(F.sort_array(F.concat(*found)))))
    df = df.withColumn(tokens, F.explode(F.array(_spans(F.col(body), TOKEN, 0, 16, len(BASE)))))
    return df.withColumn(tokens, F.explode(F.array(_free(F.col(tokens), F.col(base))))).drop(body), base, tokens


def _pairs(token: Column) -> Column:
    """Table positions of the neighbouring characters; characters outside the alphabet share position 0."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.transform(
        F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1).alias("a"), F.slice(codes, 2, F.size(codes) - 1).alias("b")),
        lambda p: p["a"] * SIDE + p["b"],
    )


def samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, label) from the texts: 1 for what the fixed patterns find, 0 for all other long tokens."""
    df, base, tokens = _searched(docs, text)
    both = F.concat(
        F.transform(base, lambda b: F.struct(b["value"].alias("token"), F.lit(1).alias("label"))),
        F.transform(tokens, lambda t: F.struct(t["value"].alias("token"), F.lit(0).alias("label"))),
    )
    return df.select(F.explode(both).alias("s")).select("s.*")


def train(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair from (token, label) rows, by smoothed counts.

    Pairs are summed in the tasks; at most 2 x 68 x 68 counts reach the driver. Without samples of
    a label its model is uniform. Tokens of under two characters and null labels count for nothing.
    """
    pairs = labelled.where("length(token) > 1 and label in (0, 1)").select("label", F.explode(_pairs(F.col("token"))).alias("pair"))
    seen = [[0] * (SIDE * SIDE), [0] * (SIDE * SIDE)]
    for row in pairs.groupBy("label", "pair").count().collect():
        seen[row.label][row.pair] = row["count"]
    logs = []
    for counts in seen:
        # the second character alone, plus one, is what a rarely seen first character falls back to
        alone = [1 + sum(counts[second::SIDE]) for second in range(SIDE)]
        total = sum(alone)
        rows = [sum(counts[first * SIDE : (first + 1) * SIDE]) for first in range(SIDE)]
        logs.append([math.log((c + SIDE * alone[i % SIDE] / total) / (rows[i // SIDE] + SIDE)) for i, c in enumerate(counts)])
    ratios = [b - a for a, b in zip(*logs, strict=True)]
    return ratios


def score(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per pair of a token of two characters or more."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    pairs = _pairs(token)
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(table, p)) / F.size(pairs)


def find(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add `secrets`: spans (start, kind, end, value) of all finds over the whole text, by start, then kind.

    Base finds are always in; a random token that touches one is left to it. Code points, end
    exclusive. Null and empty texts have none; every row stays, whatever its key, and an empty table
    gives an empty one. A column named `secrets` is replaced; all others keep name and value. Time
    grows with the length of a text, however many finds it has.
    """
    columns = [c for c in docs.columns if c.lower() != "secrets"]
    df, base, tokens = _searched(docs, text)
    added = F.filter(tokens, lambda t: score(t["value"], ratios) >= threshold)
    return df.select(*columns, F.sort_array(F.concat(base, added)).alias("secrets"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Train on the texts' own labelled samples, then find secrets in the same texts."""
    return find(docs, train(samples(docs, text)), text, threshold)


