"""Byte-pair encoding by dynamic programming over prefixes.

The encoding of a word's prefix is the encoding of the word cut there, up to one token, so each
prefix has exactly one last token. An automaton over the vocabulary lists the tokens that end at a
position; the one whose seam with the last token before it survives all merges is stored. Walking
back from the end gives the ids.

Symbols are bytes, and bytes that end a word; both fit one character, so tokens are plain strings.
"""

from __future__ import annotations

import json
import re
import unicodedata
from hashlib import sha256

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import map_texts

END = "</w>"
#: Words, pieces of words and seams that a task remembers before it starts anew.
REMEMBERED = 400_000
SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f"[^{SPACE}]+")
#: White space to str.split() but not to the pattern of the vocabulary.
SEPARATORS = "\x1c\x1d\x1e\x1f"
# Letters and numbers younger than Unicode 16, which the tokenizers library takes for
# symbols, and lower case younger than Unicode 15.1, which it knows.
YOUNG = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
SYMBOL = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in YOUNG) + "]")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files of this kind, to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A word-end BPE vocabulary file: `model.vocab`, `model.merges`, special tokens and a split pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.split = regex.compile(splits[0])
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.names = {i: t for t, i in [*self.ids.items(), *self.specials.items()]}
        letters = byte_letters()

        def symbols(token: str) -> str:
            ends = token.endswith(END) and len(token) > len(END)
            codes = [letters[c] for c in (token[: -len(END)] if ends else token)]
            return "".join(map(chr, codes[:-1])) + chr(codes[-1] + 256 * ends)

        #: per token: when it came to be (-1: a symbol) and its two parts
        self.born = dict.fromkeys(self.ids.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right = self.ids[a], self.ids[b]
            made = self.ids[a + b]
            if max(self.born[left], self.born[right]) >= rank or self.born[made] >= 0:
                raise ValueError(f"merge {rank} stands before its parts or makes a token twice")
            self.born[made], self.parts[made], self.merged[left, right] = rank, (left, right), rank
        self.seams: dict[int, bool] = {}
        self.words: dict[str, str] = {}
        self.pieces: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        whole = set()
        for token, i in sorted(self.ids.items(), key=lambda x: self.born[x[1]]):
            parts = self.parts.get(i)
            if parts is None or (parts[0] in whole and parts[1] in whole and self._holds(*parts, self.born[i])):
                whole.add(i)  # its own text gives back this token
                text = symbols(token)
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()

    def _holds(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the seam of two tokens comes earlier than `before`.

        Time runs backwards: the younger token at the seam falls apart into its parts. Equal pairs
        merge from left to right, so a seam pair precedes an equal pair on its right.
        """
        while True:
            rank = self.merged.get((a, b))
            if rank is not None and rank < before:
                return False
            if self.born[a] > self.born[b]:
                before, a = self.born[a], self.parts[a][1]
            elif self.born[b] >= 0:
                before, b = self.born[b] + 1, self.parts[b][0]
            else:
                return True

    def seam(self, a: int, b: int) -> bool:
        if len(self.seams) >= REMEMBERED:
            self.seams.clear()
        known = self.seams[a << 32 | b] = self._holds(a, b, len(self.merged))
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece of the split pattern."""
        text = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        text = text[:-1] + chr(ord(text[-1]) + 256)
        last, size_of = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        seams = self.seams
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - size
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    known = seams.get(before << 32 | token)
                    if not (self.seam(before, token) if known is None else known):
                        continue
                last[end], size_of[end] = token, size
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= size_of[at]
        return ids[::-1]

    def _piece(self, piece: str) -> str:
        """Ids of one piece of the split pattern, as decimal text."""
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            ids = " ".join(map(str, self.encode_word(piece)))
            if len(piece) <= 64:
                self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> str:
        """Ids of a run without white space, as decimal text."""
        ids: list[str] = []
        for part in self.special.split(chunk) if self.special else [chunk]:
            if part in self.specials:
                ids.append(str(self.specials[part]))
            elif part.isascii():
                ids += [self._piece(m.group()) for m in self.split.finditer(part.lower())]
            else:
                part = unicodedata.normalize("NFC", part).translate(LOWER).lower()
                ids += [self._piece(part[m.start() : m.end()]) for m in self.split.finditer(SYMBOL.sub("!", part))]
        return " ".join(ids)

    def encode_text(self, text: str) -> str:
        """All ids of a text, in decimal, between single spaces."""
        odd = any(c in text for c in SEPARATORS)
        chunks = CHUNK.findall(text) if odd else text.split()
        words = self.words
        try:
            return " ".join([words[c] for c in chunks])
        except KeyError:
            pass
        if len(words) >= REMEMBERED:
            words.clear()
        out = []
        for c in chunks:
            ids = words.get(c)
            if ids is None:
                ids = self._chunk(c)
                if len(c) <= 64:
                    words[c] = ids
            if ids:
                out.append(ids)
        return " ".join(out)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_text(text).split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens between single spaces, as a file without a decoder asks for; unknown ids are left out."""
        return " ".join([self.names[i] for i in ids if i in self.names])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the text column by the array of its token ids, on every row; null and empty texts have none."""
    column = ids

    def make():
        vocabulary = Vocabulary(path)
        return lambda texts: {column: [vocabulary.encode(t) for t in texts]}

    return map_texts(docs, text, make, f"{ids} array<int>", [c for c in docs.columns if c not in (text, ids)])


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Replace the array of ids by the text they stand for; null arrays are empty."""
    column = text

    def make():
        names = {str(i): t for i, t in Vocabulary(path).names.items()}
        return lambda rows: {column: [" ".join([names[i] for i in r.split() if i in names]) for r in rows]}

    joined = docs.withColumn(ids, F.array_join(ids, " "))
    return map_texts(joined, ids, make, f"{text} string", [c for c in docs.columns if c not in (text, ids)])


def summary(coded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Kept columns, ids, n_tokens, ids_sha256 and decoded_sha256, the text decoded from the ids."""
    both = coded.withColumn("_ids", F.col(ids)).select(*keep, ids, "_ids")
    decoded = decode(both, path, "_ids", "_text")
    return decoded.select(
        *keep,
        ids,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids, " "), 256).alias("ids_sha256"),
        F.sha2("_text", 256).alias("decoded_sha256"),
    )


def digests(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Count and digest of each text's ids, and the digest of what they decode to.

    One pass encodes a text, decodes its ids and keeps neither. Rows stay as they are: null keys,
    repeated rows, empty texts (no ids, digests of nothing).
    """

    def make():
        vocabulary = Vocabulary(path)
        names = {str(i): t for i, t in vocabulary.names.items()}

        def work(texts: list[str]) -> dict[str, object]:
            counts, coded, decoded = [], [], []
            for t in texts:
                ids = vocabulary.encode_text(t)
                each = ids.split()
                counts.append(len(each))
                coded.append(sha256(ids.encode()).hexdigest())
                decoded.append(sha256(" ".join(map(names.__getitem__, each)).encode()).hexdigest())
            return {"n_tokens": counts, "ids_sha256": coded, "decoded_sha256": decoded}

        return work

    return map_texts(docs, text, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep)
