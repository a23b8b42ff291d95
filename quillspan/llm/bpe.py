"""BPE encoding by tree concatenation, and decoding.

Texts are cut where byte-level BPE always starts a new piece, and each distinct piece is encoded once. A long run without
such a cut is split into halves until they are short; the leaves are encoded on their own and neighbours are joined up the
tree: a window around each join is encoded anew, and grown until its cuts agree with both sides.

Why one cut in common proves a join: let a be a cut of the left side's encoding, where the window starts, and t > a a cut
that both have. Merges are made by rank, leftmost first, so up to the first merge across a or t the left side and the window
see the same pairs as the whole run does; that merge would be the least pair for one of them too, and both have none there.
So left of a, and from a on, nothing changes; the right side mirrors it. This holds inside one piece of the
pre-tokenizer, which is all that is joined so.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.memory import releasing
from quillspan.session import scratch

#: A piece of more bytes than this is cut into halves.
LEAF_BYTES = 8192
#: Tokens on each side of a join that the first window takes.
WINDOW = 4
#: A text of more bytes is dealt in blocks of about BLOCK_BYTES, which are encoded in parallel.
LONG_BYTES, BLOCK_BYTES = 1 << 20, 1 << 18
#: Distinct pieces whose ids a process keeps, some 200 bytes each, and how many new ones are encoded in one text.
CACHED_PIECES, TOGETHER = 300_000, 500
#: Longer pieces aren't kept: they hardly come again.
KEPT_LENGTH = 64
#: Text that is encoded at a time.
SLICE_BYTES = 4 << 20
#: A space before white space or the end: a text with one is cut by a slower pattern. Before any other space a new piece always starts.
_ODD_GAP = r" ($|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])"
_cut_before_word = re.compile(r"(?= \S)").split
#: Characters of which one that a batch lacks marks its cuts.
_MARKS = [chr(i) for i in (1, 2, 3, 4, 5, 6, 7, 8, *range(0xE000, 0xE010))]
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"


class Encoder:
    """A tokenizer file of the tokenizers library, with what it said about short pieces kept."""

    def __init__(self, path: str, most: int = CACHED_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        to_byte = {c: b for b, c in _byte_alphabet().items()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [n.encode() if n in self.special else bytes(to_byte[c] for c in n) for n in names]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.decimal = [str(i) for i in range(size)]
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.most, self.young, self.old = most, {}, {}
        spec = json.loads(self.tokenizer.to_str())
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) and not re.search(r"[\s.,;:!?]", t.content) for t in added.values())
        #: Whether cuts between pieces are known: the library's byte-level pattern, and nothing that changes the text before it.
        self.cuts = plain and spec["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        #: Whether a piece may be joined from halves: plain merges by rank.
        self.joins = self.cuts and model["type"] == "BPE" and not any(odd)
        self._pieces_of = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]

    def forget(self) -> None:
        """Drop what is kept."""
        self.young, self.old = {}, {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of short texts, by the library alone."""
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    # Pieces

    def _fill(self, names: list[str], sizes: np.ndarray) -> list[bytes]:
        """The ids of pieces, encoded many in a text: what follows a space, or stands after a line's end, is a piece of its own; ids are parted again by the bytes they stand for."""
        spaced, lines, alone, found = [], [], [], [b""] * len(names)
        long = set(np.flatnonzero(sizes > LEAF_BYTES).tolist())
        for i, n in enumerate(names):
            if i in long:
                found[i] = self._assemble([(kind, tied, part, self.part_ids(kind, part)) for kind, tied, part in self.runs(n)]).tobytes()
            elif not n or n[-1].isspace() or n[0] != " " and n[0].isspace():
                alone.append(i)
            else:
                (spaced if n[0] == " " else lines).append(i)
        jobs = [(own[i : i + TOGETHER], gap) for own, gap in ((spaced, ""), (lines, "\n")) for i in range(0, len(own), TOGETHER)]
        coded = self.tokenizer.encode_batch_fast(["".join([gap + names[i] for i in own]) for own, gap in jobs], add_special_tokens=False)
        w = self.kind.itemsize
        for (own, gap), e in zip(jobs, coded):
            ids = np.array(e.ids, self.kind)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes[own] + len(gap))) + 1
            starts = np.concatenate([[0], ends[:-1]]) + len(gap)  # a line's end is one token
            raw = ids.tobytes()
            for i, x, y in zip(own, (w * starts).tolist(), (w * ends).tolist()):
                found[i] = raw[x:y]
        for i, x in zip(alone, self.whole([names[i] for i in alone])):
            found[i] = x.tobytes()
        return found

    def _ids_of(self, pieces: pa.Array) -> list[bytes]:
        """The ids of each distinct piece, from what is kept where possible."""
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, {}
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.young.get, names))
        lost = [i for i, x in enumerate(found) if x is None]
        if lost:
            own = [names[i] for i in lost]
            made = list(map(self.old.get, own))
            new = [k for k, x in enumerate(made) if x is None]
            sizes = pc.binary_length(pieces).to_numpy()[np.array(lost)[new]] if new else None
            for k, x in zip(new, self._fill([own[k] for k in new], sizes) if new else ()):
                made[k] = x
            self.young.update((n, x) for n, x in zip(own, made) if len(n) <= KEPT_LENGTH)
            for i, x in zip(lost, made):
                found[i] = x
        return found

    def _split(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, str] | None:
        """(pieces, where each text's begin, the mark): texts cut before each space that a word follows."""
        mark = next((m for m in _MARKS if not pc.any(pc.match_substring(column, m)).as_py()), None)
        if mark is None:
            return None
        odd = pc.match_substring_regex(column, _ODD_GAP)
        marked = pc.replace_substring(column, " ", mark + " ")
        if pc.any(odd).as_py():
            texts = column.filter(odd).to_pylist()
            marked = pc.replace_with_mask(marked, odd, pa.array([mark.join(_cut_before_word(t)) for t in texts], pa.large_string()))
        split = pc.split_pattern(marked, mark)
        return split.values, split.offsets.to_numpy(), mark

    def flat(self, texts: list[str] | pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, where each text's end), as the library gives them; ``end`` is put after each text's."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        split = self._split(column) if self.cuts and len(column) else None
        if split is None:
            found = self.whole(column.to_pylist()) if len(column) else []
            found = found if end is None else [np.append(x, self.kind.type(end)) for x in found]
            return np.concatenate([np.zeros(0, self.kind), *found]), np.cumsum([len(x) for x in found], dtype=np.int64)
        pieces, begin, mark = split
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        # Distinct pieces are cut again: after a letter and before a sign or a line's end, and around a line's end before a letter.
        finer = pc.replace_substring_regex(coded.dictionary, f"({_LETTER})([.,;:!?\n])", rf"\1{mark}\2")
        finer = pc.split_pattern(pc.replace_substring_regex(finer, f"\n({_LETTER})", rf"{mark}{chr(10)}{mark}\1"), mark)
        inner = finer.values.dictionary_encode()
        known = self._ids_of(inner.dictionary)
        size = np.fromiter(map(len, known), np.int32, len(known)) // self.kind.itemsize
        ids, n = _gather(np.frombuffer(b"".join(known), self.kind), size, inner.indices.to_numpy())
        size = np.add.reduceat(n, finer.offsets.to_numpy()[:-1]) if len(n) else n
        if end is not None:
            which = np.insert(which, begin[1:], len(size))
            ids, size = np.append(ids, self.kind.type(end)), np.append(size, size.dtype.type(1))
            begin = begin + np.arange(len(begin))
        ids, n = _gather(ids, size, which)
        return ids, np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[begin[1:]]

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        ids, ends = self.flat(texts)
        return np.split(ids, ends[:-1]) if len(ends) else []

    # Runs without a cut

    def runs(self, piece: str) -> list[tuple[str, bool, str]]:
        """(kind, tied, part) of a long piece: 'special' a special token; 'bytes' pre-tokens in the byte alphabet, joined by spaces, or the leaf of one; a tied leaf goes on with the pre-token of the part before. 'text': encoded as it is."""
        if not self.joins:
            return [("text", False, piece)]
        out, short = [], []

        def close():
            if short:
                out.append(("bytes", False, " ".join(short)))
                short.clear()

        for segment in self._pieces_of(piece):
            if segment in self.special:
                close()
                out.append(("special", False, segment))
                continue
            for token, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(segment) if segment else ():
                if len(token) <= LEAF_BYTES:
                    short.append(token)
                    if len(short) == 1000:
                        close()
                    continue
                close()
                cuts = _halves(0, len(token))
                out += [("bytes", a > 0, token[a:b]) for a, b in zip(cuts, cuts[1:])]
        close()
        return out

    def _merged(self, token: str) -> np.ndarray:
        """The ids of a pre-token, or of a part of one, by merges alone."""
        return np.array([t.id for t in self.tokenizer.model.tokenize(token)], self.kind)

    def part_ids(self, kind: str, part: str) -> np.ndarray:
        if kind == "special":
            return np.array([self.special[part]], self.kind)
        if kind == "text":
            return self.whole([part])[0] if not self.joins else self.flat([part])[0]
        return np.concatenate([self._merged(t) for t in part.split(" ")])

    def _assemble(self, parts: list[tuple[str, bool, str, np.ndarray]]) -> np.ndarray:
        """The ids of consecutive parts; leaves of one pre-token are joined two by two up the tree."""
        trees: list[list[tuple[str, np.ndarray]]] = []
        for _, tied, part, ids in parts:
            if tied:
                trees[-1].append((part, ids))
            else:
                trees.append([(part, ids)])
        out = []
        for level in trees:
            while len(level) > 1:
                level = [self._join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            out.append(level[0][1])
        return np.concatenate([np.zeros(0, self.kind), *out])

    def _join(self, one: tuple[str, np.ndarray], two: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        """Two neighbours as one: the window grows until it has a cut in common with each side, or takes the side whole."""
        (left, a), (right, b) = one, two
        k = WINDOW
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            before, after = np.cumsum(self.lengths[a[i:]]), np.cumsum(self.lengths[b[:j]])
            m, n = int(before[-1]), int(after[-1])
            window = self._merged(left[len(left) - m :] + right[:n])
            cuts = np.cumsum(self.lengths[window])
            # A cut after the window's first byte, up to the join; and one from the join on, before its last.
            if (not i or np.isin(before, cuts).any()) and (j == len(b) or np.isin(np.concatenate([[m], m + after[:-1]]), cuts).any()):
                return left + right, np.concatenate([a[:i], window, b[j:]])
            k *= 2

    def blocks(self, text: str) -> list[tuple[str, bool, str]]:
        """A long text as parts, in order, that can be encoded apart: of about BLOCK_BYTES where there are cuts, else as ``runs`` makes them."""
        if not self.joins:
            return [("text", False, text)]
        out, held, size = [], [], 0
        for piece in _cut_before_word(text):
            if len(piece) > BLOCK_BYTES // 4:
                out += [("text", False, "".join(held))] if held else []
                out += self.runs(piece)
                held, size = [], 0
                continue
            held.append(piece)
            size += len(piece)
            if size >= BLOCK_BYTES // 2:
                out.append(("text", False, "".join(held)))
                held, size = [], 0
        return out + ([("text", False, "".join(held))] if held else [])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def digest(self, ids: np.ndarray) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the decimal ids with commas, SHA-256 of the decoded text)."""
        listed = ids.tolist()
        decimal = ",".join(map(self.decimal.__getitem__, listed)).encode()
        text = b"".join(map(self.bytes.__getitem__, listed)).decode("utf-8", "replace").encode()
        return len(listed), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(text).hexdigest()


def _gather(ids: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the pieces ``which`` one after another, how many of each), pieces lying in ``ids`` with the sizes given."""
    start = np.cumsum(size, dtype=np.int64) - size
    n = size[which]
    total = int(n.sum(dtype=np.int64))
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    at = np.repeat((start[which] - (np.cumsum(n, dtype=np.int64) - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return ids[at], n


def _halves(lo: int, hi: int) -> list[int]:
    """The ends of the leaves of [lo, hi), halved until they are short."""
    if hi - lo <= LEAF_BYTES:
        return [lo, hi]
    mid = (lo + hi) // 2
    return _halves(lo, mid) + _halves(mid, hi)[1:]


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself where it prints, else the next free code point from 256 on."""
    prints = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in prints else chr(next(spare)) for b in range(256)}


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of a text column."""
    n = max(1, -(-batch.num_rows * size // max(1, batch.column(column).nbytes)))
    return (batch.slice(i, n) for i in range(0, batch.num_rows, n))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = CACHED_PIECES) -> Encoder:
    """The process's encoder for a file, which keeps the ids of ``most`` pieces."""
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]


def _digests(own: Encoder, lead: list[pa.Array], found: list[np.ndarray], names: list[str], keep_ids: bool) -> pa.RecordBatch:
    rows = [own.digest(x) for x in found]
    out = [*lead, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
    if keep_ids:
        out.append(pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row of ``docs``, one for one.

    ``path``: a byte-level BPE file of the tokenizers library that every executor can open. Ids are those of the whole
    text without special tokens added; a special token's string in a text is that token. Null texts count as empty
    (no ids; the hashes are those of empty strings). Repeated and null keys are kept, ties and repeated rows get a row
    each; an empty table gives an empty result; only the two named columns are read. ids: little-endian 32-bit.

    Texts are encoded where they are read, without a shuffle. Only distinct texts of more than ``long_bytes`` are dealt out:
    their blocks and leaves are rows of their own, encoded by all tasks, and each text's parts meet by its hash to be joined.
    """
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                found = own.encode(pc.fill_null(part.column("text"), ""))
                yield _digests(own, [part.column("key")], found, ["key", *names], keep_ids)
        own.forget()

    out = slim.where(~long).mapInArrow(releasing(run), f"key {kind}, {columns}")
    if slim.where(long).limit(1).count():
        keys = slim.where(long).select("key", F.sha2("text", 256).alias("h"))
        done = scratch(_encode_long(slim.where(long).select("text"), path, names, columns, keep_ids), "long")
        out = out.unionByName(keys.join(done, "h").drop("h"))
    return out.withColumnRenamed("key", key)


def _encode_long(texts: DataFrame, path: str, names: list[str], columns: str, keep_ids: bool) -> DataFrame:
    """(h, ...) for each distinct text, h its SHA-256: parts are dealt by (h, seq), and meet again in order by h."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for h, t in zip(batch.column("h").to_pylist(), batch.column("text")):
                rows = own.blocks(t.as_py())
                for i in range(0, len(rows), 64):
                    kinds, tied, parts = zip(*rows[i : i + 64])
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays([pa.array([h] * n), pa.array(range(i, i + n), pa.int32()), pa.array(kinds), pa.array(tied), pa.array(parts)], ["h", "seq", "kind", "tied", "part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = own.part_ids(row.column("kind")[0].as_py(), row.column("part")[0].as_py())
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([ids.tobytes()], pa.binary())], [*batch.schema.names, "ids"])
        own.forget()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        rows = (tuple(batch.column(c)[i].as_py() for c in ("h", "kind", "tied", "part", "ids")) for batch in batches for i in range(batch.num_rows))
        for h, parts in groupby(rows, lambda r: r[0]):
            ids = own._assemble([(kind, tied, part if kind == "bytes" else "", np.frombuffer(raw, own.kind)) for _, kind, tied, part, raw in parts])
            yield _digests(own, [pa.array([h])], [ids], ["h", *names], keep_ids)

    shape = "h string, seq int, kind string, tied boolean, part string"
    distinct = texts.withColumn("h", F.sha2("text", 256)).dropDuplicates(["h"])
    parts = scratch(distinct.mapInArrow(releasing(cut), shape), "parts")
    coded = parts.repartition(F.col("h"), F.col("seq")).mapInArrow(releasing(encode), f"{shape}, ids binary")
    return coded.repartition("h").sortWithinPartitions("h", "seq").mapInArrow(releasing(join), f"h string, {columns}")


def vocabulary() -> str:
    """The file of the query's contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8(spark, sf_dir: str) -> DataFrame:
    """The query: every document encoded and decoded."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
