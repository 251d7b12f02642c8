"""Token ids of a corpus as binary files of Simple-8b blocks, in the order of the keys.

A file is a chain of blocks of little-endian 64-bit words; a block holds whole documents:

    magic | words of the block | ids | documents | code words | escaped values
    keys of the documents | their numbers of ids (top bit: the key is null)
    ids before each 64th code word | code words | escaped values | end mark

Blocks can be skipped by their length, and a slice of ids is decoded from the offset table
without the words before it. Spark's own writer commits the files, so they may lie in any store
and a lost task leaves nothing behind. `index` is a table with the place of each file's first id.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm import simple8b
from footfall.llm.common import steps

MAGIC = np.frombuffer(b"S8BLOCK1", "<u8")[0]
END = "\nS8BEND\n"  # eight bytes, so that files stay word-aligned
HEAD = 6
NULL = np.uint64(1) << np.uint64(63)
#: Ids after which a block ends, with the document that reaches them; blocks of a file.
BLOCK_IDS = 1 << 18
FILE_BLOCKS = 64
#: Pieces of text whose ids a worker remembers, and their longest length.
PIECES, PIECE_CHARS = 400_000, 48
#: Bytes of text that are cut into pieces at once.
STEP_BYTES = 4_000_000
#: Pieces that the library sees as one text; it needs some hundred bytes a token meanwhile.
TOGETHER = 20_000
#: A text falls apart at single blanks between letters, digits and ASCII punctuation: no token crosses such a place.
EDGE = r"[\w!-/:-@\[-`{-~]"
SEAM = re.compile(f"(?<={EDGE}) (?={EDGE})")
PIECE = re.compile(f"\n?{EDGE}(?:.*{EDGE})?")
MARKS = ",.;:!?"
EMPTY = np.empty(0, "<u4")


class Known:
    """Ids of pieces of text: one array of all, and where each piece's begin."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)
        self.again = np.empty(0, bool)  # asked for after the batch that brought them

    def add(self, pieces: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int64)])
        self.flat = np.concatenate([self.flat, flat])
        self.again = np.concatenate([self.again, np.zeros(len(pieces), bool)])

    def places(self, pieces: Iterable[str], n: int) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, pieces), np.int64, n)

    def found(self, pieces: np.ndarray) -> np.ndarray:
        """Their places, -1 for those not known."""
        return np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after the other, how many each has)."""
        sizes = self.sizes[places]
        begins = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.starts[places] - begins, sizes) + np.arange(sizes.sum())], sizes

    def keep(self, pieces: Iterable[str]) -> None:
        """Forget all but these and what was asked for again since the last time; most pieces come only once."""
        held = [*pieces, *(p for p, at in self.index.items() if self.again[at])]
        held = list(dict.fromkeys(p for p in held if p in self.index))
        flat, sizes = self.ids(self.places(held, len(held)))
        self.__init__()
        self.add(held, flat, sizes)


class Encoder:
    """Ids of texts by the tokenizers library, which sees each distinct piece of text once in a while.

    Pieces are independent only under the byte-level splitting pattern, where a blank always
    begins a token; the vocabulary file is checked for that, and others are encoded as whole texts.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        made = json.loads(self.library.to_str())
        split = made["pre_tokenizer"] or {}
        own = [t for t in made["added_tokens"] if " " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        self.by_pieces = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not made["normalizer"] and not own
        self.special = [t["content"] for t in made["added_tokens"]]
        self.known = Known()
        self.marks = [f" {m}" for m in MARKS]  # no piece has a blank
        self.line_end = self.library.token_to_id("\u010a")  # how the vocabulary writes it
        self.known.add(self.marks, np.concatenate(self._encode(list(MARKS))), np.ones(len(MARKS), np.int64))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(array("I", e.ids), "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of plain pieces: those behind a blank, and those behind a line end, which begin with it.

        A mark after a letter or digit is a token of its own, and so is a line end beside plain
        edges; so many pieces are encoded as one text, and line ends part their ids.
        """
        marked = [p for p in new if p[-1] in MARKS and p[-2:-1] < "\u0250" and p[-2:-1].isalnum()]
        cores = [p[:-1] for p in marked]
        new = set(new).difference(marked).union(cores).difference(self.known.index)
        behind, begun = [p for p in new if p[0] != "\n"], [p for p in new if p[0] == "\n"]
        for at in range(0, len(behind), TOGETHER):
            part = behind[at : at + TOGETHER]
            ids = self._encode([" " + "\n ".join(part) + "\n"])[0]
            self.known.add(part, ids[ids != self.line_end], np.diff(np.flatnonzero(ids == self.line_end), prepend=-1) - 1)
        for at in range(0, len(begun), TOGETHER):
            part = begun[at : at + TOGETHER]
            ids = self._encode(["".join(part)])[0]
            self.known.add(part, ids, np.diff(np.flatnonzero(ids == self.line_end), append=len(ids)))
        pairs = np.stack([self.known.places(cores, len(cores)), self.known.places([f" {p[-1]}" for p in marked], len(marked))], 1)
        flat, sizes = self.known.ids(pairs.ravel())
        self.known.add(marked, flat, sizes.reshape(-1, 2).sum(1))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.by_pieces or not len(texts):
            return self._encode(texts.to_pylist())
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        counts = pc.list_value_length(pieces).to_numpy()
        coded = pc.dictionary_encode(pieces.flatten())
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known.index) > PIECES:
            self.known.keep(self.marks)
        places = self.known.found(names)
        self.known.again[places[places >= 0]] = True
        new = np.flatnonzero(places < 0)
        special = [t for t in self.special if pc.any(pc.match_substring(coded.dictionary, t)).as_py()]
        self._learn([p for p in names[new] if len(p) <= PIECE_CHARS and PIECE.fullmatch(p) and not any(t in p for t in special)])
        places[new] = self.known.found(names[new])

        begins = np.cumsum(counts) - counts
        plain = np.minimum.reduceat(places[codes], begins) >= 0
        used = np.repeat(plain, counts)
        used[begins] = False
        flat, sizes = self.known.ids(places[codes[used]])
        ends = np.cumsum(np.where(plain, counts - 1, 0))
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
        first = pc.list_element(pieces, 0).to_pylist()
        rest = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        rough = np.flatnonzero(~plain).tolist()  # where not every blank and line end is a seam
        if rough:
            cut = [SEAM.split(t) for t in texts.take(pa.array(rough)).to_pylist()]
            own = list({p for part in cut for p in part[1:]})
            own = dict(zip(own, self._encode([" " + p for p in own]), strict=True))
            for i, part in zip(rough, cut, strict=True):
                first[i], rest[i] = part[0], np.concatenate([EMPTY, *map(own.__getitem__, part[1:])])
        return [np.concatenate(x) for x in zip(self._encode(first), rest, strict=True)]


@lru_cache(1)
def encoder(vocabulary: str) -> Encoder:
    """The worker's own, which goes on from task to task."""
    return Encoder(vocabulary)


def block(keys: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The words of a block, without its end mark."""
    words, escaped = simple8b.pack(np.concatenate(ids))
    starts = simple8b.offsets(words)
    sizes = np.array([len(x) for x in ids], np.uint64) | np.where([k is None for k in keys], NULL, np.uint64(0))
    head = [MAGIC, HEAD + 2 * len(keys) + len(starts) + len(words) + len(escaped), sum(map(len, ids)), len(keys), len(words), len(escaped)]
    named = np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64)
    return np.concatenate([np.array(head, np.uint64), named, sizes, starts, words, escaped]).astype("<u8").tobytes()


def blocks(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, null keys, numbers of ids, offset table, code words, escaped values) of each block of a file."""
    words = np.frombuffer(content, "<u8")
    at = 0
    while at < len(words):
        magic, length, _, docs, code, escaped = (int(x) for x in words[at : at + HEAD])
        if magic != int(MAGIC) or at + length + 1 > len(words):
            raise ValueError("not a block of token ids")
        table = length - HEAD - 2 * docs - code - escaped
        ends = np.cumsum([HEAD, docs, docs, table, code, escaped])
        keys, sizes, starts, packed, rest = (words[at + a : at + b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        yield keys.view("<i8"), (sizes & NULL) != 0, (sizes & ~NULL).astype(np.int64), starts, packed, rest
        at += length + 1


def write(docs: DataFrame, place: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int | None = 0) -> None:
    """Encodes whole texts and writes `place`/data (files of blocks) and `place`/index (a table).

    Ids follow ascending keys, null keys first; rows of one key follow a hash of their text, and
    every row is a document of its own, however often it is repeated. A null text is empty; `end`
    is appended to each document (None: nothing). Keys are whole numbers. Other columns are not
    read, so their names do not matter. An empty table gives a folder without blocks. A document
    is never cut: a very long one makes a longer block.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = ["key", F.xxhash64("text"), "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    tail = np.array([] if end is None else [end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        keys, ids, held = [], [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([block(keys, ids)], pa.binary())], ["block"])

        for batch in batches:
            for part in steps([batch], "text", STEP_BYTES, batch.num_rows):
                for k, found in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    keys.append(k)
                    ids.append(np.concatenate([found, tail]))
                    held += len(ids[-1])
                    if held >= BLOCK_IDS:
                        yield made()
                        keys, ids, held = [], [], 0
        if keys:
            yield made()

    # the bytes of a block pass through the text writer as they are
    packed = ranged.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    packed.write.option("lineSep", END).option("maxRecordsPerFile", FILE_BLOCKS).text(f"{place}/data")
    index(docs.sparkSession, f"{place}/data").write.parquet(f"{place}/index")


def _files(spark: SparkSession, data: str) -> DataFrame:
    """(part, piece, content): a file's task and its number among the files of that task."""
    name = F.element_at(F.split("path", "/"), -1)
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("int")
    found = spark.read.format("binaryFile").load(data)
    return found.select(number(r"^part-(\d+)").alias("part"), number(r"-c(\d+)\.").alias("piece"), "content")


def index(spark: SparkSession, data: str) -> DataFrame:
    """(part, piece, n_docs, n_ids, before): for each file the ids of all files before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ids = [], []
            for content in batch.column(2):
                sizes = [s for _, _, s, *_ in blocks(content.as_buffer())]
                docs.append(sum(map(len, sizes)))
                ids.append(int(sum(s.sum() for s in sizes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(docs, pa.int64()), pa.array(ids, pa.int64())], ["part", "piece", "n_docs", "n_ids"])

    counted = _files(spark, data).mapInArrow(run, "part int, piece int, n_docs bigint, n_ids bigint")
    # running sums inside groups of a thousand tasks, then over the groups
    group = F.floor(F.col("part") / 1000).alias("group")
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = counted.select("*", group).withColumn("inside", earlier(Window.partitionBy("group").orderBy("part", "piece")))
    groups = files.groupBy("group").agg(F.sum("n_ids").alias("n_ids"))
    groups = groups.select("group", earlier(Window.orderBy("group")).alias("outside"))
    return files.join(groups, "group").select("part", "piece", "n_docs", "n_ids", (F.col("inside") + F.col("outside")).alias("before"))


def read(spark: SparkSession, place: str, ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of every document in the files below `place`.

    start counts the ids of all documents before; ids_crc32 is taken over the ids as little-endian
    unsigned 32-bit integers (wider ids: 64-bit). Without `ids` the lists themselves are left out.
    """
    schema = "part int, piece int, key bigint, ahead bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, piece, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ahead = 0
                for keys, nulls, sizes, _, words, escaped in blocks(content.as_buffer()):
                    values = simple8b.unpack(words, escaped)
                    edges = np.concatenate([[0], np.cumsum(sizes)])
                    plain = values.astype("<u8" if len(escaped) or values.max(initial=0) >> np.uint64(32) else "<u4")
                    sums = [zlib.crc32(plain[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    n = len(keys)
                    columns = [pa.array([part] * n, pa.int32()), pa.array([piece] * n, pa.int32()), pa.array(keys, pa.int64(), mask=nulls)]
                    columns += [pa.array(edges[:-1] + ahead), pa.array(sizes), pa.array(sums, pa.int64())]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values[: edges[-1]].view(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    ahead += int(edges[-1])

    names = [part.split()[0] for part in schema.split(", ")]
    found = _files(spark, f"{place}/data").mapInArrow(run, schema)
    files = spark.read.schema("part int, piece int, before bigint").parquet(f"{place}/index")
    joined = found.join(files, ["part", "piece"])
    return joined.select("key", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
