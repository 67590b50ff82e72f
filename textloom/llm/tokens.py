"""Problem 7: token ids of every text by a public byte-level BPE vocabulary, and the way back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.lineage import spread, table

#: Folder of the vocabulary files.
FOLDER = "/opt/tokenizers"
#: Pieces and states that a task remembers; past that it forgets them all and determinises anew.
REMEMBERED = 300_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_pattern() -> str:
    """How byte_bpe_50k cuts a text into pieces before merging (fixed values of the vocabulary)."""
    return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Transducer:
    """The merges of a vocabulary as a finite-state transducer over bytes, determinised as texts need it.

    After each byte the greedy merging of what has been read ends in exactly one token. It is the longest token that
    the bytes end in and that may follow the last token of what is before it; two tokens may follow each other if
    no merge across their border comes before the merges that build them. So all that the future depends on is the
    longest suffix that can still grow into a token and the last tokens at the places within it: that is a state. A
    transition gives the next state and the last token. Once all places within the suffix lead back to the same
    place, the tokens up to there are certain and are emitted; the lookahead is bounded by the longest token.
    """

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]):
        """tokens by id; merges (left, right, merged) in the order of their rank."""
        self.tokens = tokens
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.born = dict.fromkeys(range(len(tokens)), -1) | {m: r for r, (_, _, m) in enumerate(merges)}
        self.halves = {m: (a, b) for a, b, m in merges}
        usable = [t for t in range(len(tokens)) if len(tokens[t]) == 1 or t in self.halves]
        self.id = {tokens[t]: t for t in usable}
        self.begins = {tokens[t][:n] for t in usable for n in range(1, len(tokens[t]) + 1)}
        self.longest = max(map(len, self.id), default=1)
        self.follows: dict[tuple[int, int], bool] = {}
        self.next: dict[tuple, tuple] = {}
        self.pieces: dict[bytes, list[int]] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves just these two tokens."""
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > REMEMBERED * 4:
                self.follows.clear()
            known = self.follows[a, b] = self._stable(a, b)
        return known

    def _stable(self, a: int, b: int) -> bool:
        never = len(self.rank) + 1
        right, left = [(a, never)], [(b, never)]  # what stands at the border, newest first, and when it is merged away
        while right[-1][0] in self.halves:
            right.append((self.halves[right[-1][0]][1], self.born[right[-1][0]]))
        while left[-1][0] in self.halves:
            left.append((self.halves[left[-1][0]][0], self.born[left[-1][0]]))
        i, j = len(right) - 1, len(left) - 1
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            r = self.rank.get((x, y))
            if r is not None and r < x_until and r <= y_until:  # of equal ranks the left one is merged first
                return False
            if i == 0 and j == 0:
                return True
            if j == 0 or (i > 0 and x_until <= y_until):
                i -= 1
            else:
                j -= 1

    def _step(self, state: tuple, byte: int) -> tuple:
        """(next state, last token) after a byte. A state is (suffix, last tokens at the places in it, from its start)."""
        suffix, lasts = state
        whole = suffix + bytes((byte,))
        found = -1
        for start in range(len(whole)):
            t = self.id.get(whole[start:])
            if t is not None and (lasts[start] < 0 or self.may_follow(lasts[start], t)):
                found = t
                break
        if found < 0:
            raise ValueError(f"no token for byte {byte}")
        start = 0
        while whole[start:] and whole[start:] not in self.begins:
            start += 1
        return (whole[start:], (*lasts, found)[start:]), found

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        ids = self.pieces.get(data)
        if ids is None:
            if len(self.pieces) > REMEMBERED:
                self.pieces.clear()
            ids = self.pieces[data] = [t for part in self.emit(data) for t in part]
        return ids

    def emit(self, data: bytes) -> Iterator[list[int]]:
        """The ids of one piece as soon as they are certain."""
        state = (b"", (-1,))
        lasts, start, settled = [], 0, 0  # last tokens from start on; places before settled are emitted
        for place, byte in enumerate(data):
            step = self.next.get((state, byte))
            if step is None:
                if len(self.next) > REMEMBERED:
                    self.next.clear()
                step = self.next[state, byte] = self._step(state, byte)
            state, last = step
            lasts.append(last)
            if place - settled > 8 * self.longest:
                ends = {max(place + 1 - k, settled) for k in range(len(state[0]) + 1)}
                while len(ends) > 1:  # the paths meet further back
                    far = max(ends)
                    ends.remove(far)
                    ends.add(far - len(self.tokens[lasts[far - 1 - start]]))
                certain = ends.pop()
                if certain > settled:
                    yield self._path(lasts, start, certain, settled)
                    lasts, start, settled = lasts[certain - start :], certain, certain
        yield self._path(lasts, start, len(data), settled)

    def _path(self, lasts: list[int], start: int, end: int, stop: int) -> list[int]:
        out = []
        while end > stop:
            t = lasts[end - 1 - start]
            out.append(t)
            end -= len(self.tokens[t])
        return out[::-1]


class Decoder:
    """Ids back to text, one at a time, with an incremental UTF-8 state machine."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.reset()

    def reset(self) -> None:
        self.need, self.point, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, token: int) -> str:
        """The characters that the token completes; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for b in self.tokens[token]:
            if self.need:
                if self.low <= b <= self.high:
                    self.low, self.high = 0x80, 0xBF
                    self.point, self.need = self.point << 6 | b & 0x3F, self.need - 1
                    if not self.need:
                        out.append(chr(self.point))
                    continue
                out.append("�")
                self.reset()
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.point = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.point = 2, b & 0x0F
                self.low, self.high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.need, self.point = 3, b & 0x07
                self.low, self.high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, _ = self.need, self.reset()
        return "�" if left else ""


def vocabulary(folder: str) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """(tokens by id, merges) of byte_bpe_50k; special tokens are no part of it, so their strings are ordinary text."""
    with open(f"{folder}/byte_bpe_50k.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    coded = {w: bytes(letters[c] for c in w) for w in model["vocab"] if all(c in letters for c in w)}
    tokens = [b""] * (max(model["vocab"].values()) + 1)
    for w, t in model["vocab"].items():
        tokens[t] = coded.get(w, b"")
    merges = []
    for m in model["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        merges.append((model["vocab"][a], model["vocab"][b], model["vocab"][a + b]))
    return tokens, merges


def _encode(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        fst, cut = Transducer(*vocabulary(folder)), regex.compile(split_pattern())
        for pdf in batches:
            ids = []
            for text in pdf["text"]:
                one: list[int] = []
                for piece in cut.findall(text or ""):
                    one += fst.piece(piece.encode("utf-8", "surrogatepass"))
                ids.append(one)
            yield pd.DataFrame({"id": pdf["id"], "ids": ids})

    return run


def _decode(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(vocabulary(folder)[0])
        for pdf in batches:
            texts = ["".join(map(decoder.feed, ids)) + decoder.end() for ids in pdf["ids"]]
            yield pd.DataFrame({"id": pdf["id"], "text": texts})

    return run


def encode(df: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(id, ids) of df(id, text): one row for each row of df that has an id.

    A null text and an empty text give an empty list; white space and the strings of special tokens are ordinary text."""
    return spread(df.select("id", "text").where("id IS NOT NULL")).mapInPandas(_encode(folder), "id long, ids array<int>")


def decode(df: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(id, text) of df(id, ids): the way back; null ids are not allowed, an empty list gives an empty text."""
    return df.select("id", "ids").mapInPandas(_decode(folder), "id long, text string")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of every document after encoding and decoding; null texts come back empty."""
    return decode(encode(_documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")


ORACLES = {"p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
