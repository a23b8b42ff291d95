"""Benchmark decontamination: items found in documents within a budget of word edits.

An item of m words may differ by k = m * RATE edits of words. Cut into k + 1 pieces, one piece must stand unchanged in
any text that is within the budget. An Aho-Corasick automaton finds all exact pieces in one pass over a text, and the
region around each is verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.memory import parts as part_of
from quillspan.llm.memory import releasing
from quillspan.llm.words import stretches
from quillspan.session import scratch

RATE = 0.15
#: Item text that one pass over the documents takes; more items are taken in blocks.
BLOCK_BYTES = 16 << 20

_words = re.compile(r"[^\W_]+").findall


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _words((text or "").lower())


def pieces(words: list[str], edits: int) -> list[tuple[int, list[str]]]:
    """(place, words) of edits + 1 pieces of like length."""
    cuts = [len(words) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: list[str], text: list[str]) -> int:
    """The least edit distance of the pattern to any run of the text's words, all words in one column of bits."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    has: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        has[w] |= 1 << i
    plus, minus, score = full, 0, m
    best = m
    for w in text:
        eq = has.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        best = min(best, score)
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(eq | minus | up))
        minus = up & (eq | minus)
    return best


class Matcher:
    """The pieces of a block of items, and their search in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for key, text in items:
            words = tokens(text)
            if not words:
                continue
            edits = int(len(words) * rate)
            for at, piece in pieces(words, edits):
                where[f" {' '.join(piece)} "].append((len(self.items), at))
            self.items.append((key, words, edits))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        #: Words before a stretch's end that an item which ends in the next one may take.
        self.reach = max((len(words) + 2 * edits for _, words, edits in self.items), default=0)

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item, least distance) of each item within its budget; a long text is read in stretches that overlap."""
        best: dict[int, int] = {}
        tail: list[str] = []
        for raw in stretches(text):
            words = tail + tokens(raw.decode())
            for i, d in self._within(words):
                best[i] = min(d, best.get(i, d))
            tail = words[-self.reach :] if self.reach else []
        return [(self.items[i][0], d) for i, d in best.items()]

    def _within(self, words: list[str]) -> list[tuple[int, int]]:
        """(number of the item, least distance) of each item within its budget in a run of words."""
        flat = f" {' '.join(words)} "
        hits = list(self.automaton.iter(flat)) if self.items else []
        if not hits:
            return []
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        likely = defaultdict(set)
        for end, (n, places) in hits:
            word = bisect_left(starts, end - n + 1)
            for item, off in places:
                likely[item].add(word - off)
        out = []
        for item, begins in likely.items():
            _, pattern, edits = self.items[item]
            best = edits + 1
            for lo, hi in _merged(sorted(begins), len(pattern), edits):
                best = min(best, myers(pattern, words[max(0, lo) : max(0, hi)]))
                if not best:
                    break
            if best <= edits:
                out.append((item, best))
        return out


def _merged(begins: list[int], m: int, edits: int) -> list[tuple[int, int]]:
    """The regions around likely begins, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for b in begins:
        lo, hi = b - edits, b + m + edits
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, item_key, distance) for each pair of a row of ``docs`` and an item that it holds within the item's budget.

    Words are lower-case runs of letters and digits; punctuation and layout don't count. distance: the least number of
    words to put in, leave out or change to make the item a run of the document's words; the budget is ``rate`` times
    the item's words, rounded down, so items under seven words must stand there as they are. Items without words (nulls
    and empty ones too) match nothing; null and empty documents hold nothing. Null keys stay null; repeated rows of either
    table give repeated pairs; an empty table gives none. Other columns aren't read.

    Documents aren't shuffled. Items are a stated query set, sent to the tasks in blocks of about ``block_bytes`` of text; of
    several blocks each is searched and its pairs written before the next is fetched, so neither the driver nor a
    task holds two.
    """
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    shape = f"key {kind}, item long, distance int"
    blocks = item_blocks(items, item_key, item_text, block_bytes)
    found = [slim.mapInArrow(releasing(_search(block, rate)), shape) for block in blocks] if len(blocks) == 1 else [scratch(slim.mapInArrow(releasing(_search(block, rate)), shape), "pairs") for block in blocks]
    return reduce(DataFrame.unionByName, found).withColumnRenamed("key", key).withColumnRenamed("item", item_key)


class Blocks:
    """The items in blocks, each fetched when it is asked for."""

    def __init__(self, items: DataFrame, n: int):
        self.items, self.n = items, n

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[list[tuple[int, str]]]:
        for b in range(self.n):
            yield [(r.item, r.text) for r in self.items.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.n)) == b).collect()]


def item_blocks(items: DataFrame, item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> Blocks:
    """The items that have a text, by a hash, in blocks of about ``block_bytes``."""
    own = items.select(items[item_key].cast("long").alias("item"), items[item_text].alias("text")).where("text is not null")
    volume = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return Blocks(own, max(1, -(-volume // block_bytes)))


def _search(block: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, rate)
        for batch in part_of(batches):
            at, item, distance = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for k, d in matcher.find(t):
                    at.append(i)
                    item.append(k)
                    distance.append(d)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(distance, pa.int32())], ["key", "item", "distance"])

    return run


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no item within its budget, as ``contamination`` counts it.

    A row is judged by its own text alone, so null and repeated keys don't matter. Null and empty texts stay.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def free_of(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in part_of(batches):
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column(text).to_pylist()], pa.bool_()))

        return run

    blocks = item_blocks(items, item_text="text", block_bytes=block_bytes)
    for b, block in enumerate(blocks):
        docs = docs.mapInArrow(releasing(free_of(block)), kinds)
        if b + 1 < len(blocks):
            docs = scratch(docs, "free")
    return docs


def op7(spark, sf_dir: str) -> DataFrame:
    """The query: every pair of a document and a benchmark item that it holds."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
