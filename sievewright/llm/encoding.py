"""Encoding of texts with a public byte-level BPE vocabulary (problem 7): tree concatenation.

A text falls apart at *safe* boundaries, places where the split pattern parts it whatever stands around:
a change of the class of characters (letters, digits, other marks, blanks), but for a blank in front of
its word and an apostrophe in front of letters.  What lies between two of them is unsplit text; only
there do the ids of one place depend on those of another.

* Unsplit text over ``piece`` bytes is encoded by halves, and the halves of halves, down to ``piece``
  bytes.  A join re-encodes a window around the seam that grows until both sides agree with it exactly:
  a sequence of BPE tokens is the encoding of its bytes just when every two neighbours are, together,
  encoded as themselves, so a window is right when the pairs at its two borders pass this test.
* A text over ``leaf`` characters is cut into leaves, rows of their own that any executor encodes: at
  safe boundaries where there are some (such leaves are joined by putting them in a row), else inside the
  unsplit text, whose parts are joined by windows as above.  No join encodes more than its windows.

A document's ids are one value of one row, so they meet in one task at the end, which encodes the
windows at the seams and nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievewright.session import spread

TOKENIZERS = "/opt/tokenizers"
#: Session setting that names another folder of the vocabulary.
FOLDER_SETTING = "sievewright.tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The split pattern of the vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Safe boundaries: no match of the pattern holds both sides of one.
SAFE = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})"
#: Characters of a leaf; longer texts are cut into leaves.
LEAF = 8_192
#: Unsplit text of more bytes is halved.
PIECE = 128
#: Pairs of tokens whose test is kept.
KEPT_PAIRS = 200_000

_cache: dict[tuple[str, int], "Encoder"] = {}


class Encoder:
    """Encodes texts; holds the vocabulary once per Python worker."""

    def __init__(self, vocabulary: bytes, piece: int = PIECE):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.split, self.safe = regex.compile(PATTERN), regex.compile(SAFE)
        self.at_most = max(2, piece)
        self.window_bytes = 0  # bytes that joins encoded, for tests and reports
        self._fits: dict[tuple[int, int], bool] = {}

    # unsplit text

    def piece(self, b: bytes) -> list[int]:
        """Ids of one pre-token, by halves."""
        if len(b) <= self.at_most:
            return self.bpe._encode_single_piece(b)
        parts = -(-len(b) // self.at_most)
        step = -(-len(b) // parts)
        return self.tree([self.bpe._encode_single_piece(b[i : i + step]) for i in range(0, len(b), step)])

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Ids of the parts of one pre-token, joined in pairs, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def fits(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self._fits:
            if len(self._fits) > KEPT_PAIRS:
                self._fits.clear()
            self._fits[key] = self.bpe._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self._fits[key]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the bytes of ``left`` and ``right`` together."""
        if not left or not right:
            return left + right
        k = 4
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            data = b"".join(self.bytes_of[t] for t in left[a:] + right[:b])
            self.window_bytes += len(data)
            window = self.bpe._encode_single_piece(data)
            if (a == 0 or self.fits(left[a - 1], window[0])) and (b == len(right) or self.fits(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    # texts

    def encode(self, text: str) -> list[int]:
        words = text.split()
        unsplit = max(map(len, words), default=0)
        if unsplit * 4 > self.at_most:  # perhaps so many bytes
            unsplit = max(len(w.encode("utf-8", "replace")) for w in words if len(w) * 4 > self.at_most)
        # a run of blanks is unsplit too
        blanks = len(text) - sum(map(len, words)) - len(words)
        if max(unsplit, blanks) <= self.at_most:
            return self.bpe.encode_ordinary(text)
        out: list[int] = []
        for m in self.split.finditer(text):
            out += self.piece(m.group().encode("utf-8", "replace"))
        return out

    def _last_safe(self, text: str, start: int, stop: int) -> int:
        """The last safe boundary in (start, stop], or start."""
        w = 64
        while True:
            lo = max(start, stop - w)
            # one character on either side, which the boundary looks at
            at = [m.start() for m in self.safe.finditer(text[max(0, lo - 1) : stop + 1])]
            at = [i + max(0, lo - 1) for i in at]
            at = [i for i in at if start < i <= stop]
            if at or lo == start:
                return at[-1] if at else start
            w *= 4

    def _next_safe(self, text: str, start: int) -> int:
        """The first safe boundary after start, or the end of the text."""
        w = 64
        while True:
            hi = min(len(text), start + w)
            base = max(0, start - 1)
            at = next((i for m in self.safe.finditer(text[base : hi + 1]) if start < (i := m.start() + base) <= hi), None)
            if at is not None or hi == len(text):
                return len(text) if at is None else at
            w *= 4

    def leaves(self, text: str, leaf: int) -> Iterator[tuple[int, int, bool, bytes]]:
        """(place, part, whole, bytes) of a text: whole leaves, and parts of unsplit text."""
        leaf = max(1, leaf)
        at = place = 0
        while at < len(text):
            stop = min(len(text), at + leaf)
            end = stop if stop == len(text) else self._last_safe(text, at, stop)
            if end > at:
                yield place, 0, True, text[at:end].encode("utf-8", "replace")
                place += 1
                at = end
                continue
            end = self._next_safe(text, at)
            for m in self.split.finditer(text[at:end]):
                b = m.group().encode("utf-8", "replace")
                for part, i in enumerate(range(0, len(b), leaf)):
                    yield place, part, False, b[i : i + leaf]
                place += 1
            at = end

    def leaf_ids(self, whole: bool, b: bytes) -> list[int]:
        return self.encode(b.decode("utf-8")) if whole else self.piece(b)

    def concatenate(self, leaves: list[tuple[int, int, list[int]]]) -> list[int]:
        """Ids of a text from (place, part, ids) of its leaves."""
        out: list[int] = []
        leaves = sorted(leaves, key=lambda x: x[:2])
        i = 0
        while i < len(leaves):
            j = i
            while j < len(leaves) and leaves[j][0] == leaves[i][0]:
                j += 1
            out += self.tree([x[2] for x in leaves[i:j]]) if j > i + 1 else leaves[i][2]
            i = j
        return out


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def encoder(data: bytes | None = None, piece: int = PIECE) -> Encoder:
    """The worker's encoder of a vocabulary file's content."""
    data = vocabulary() if data is None else data
    key = (hashlib.md5(data).hexdigest(), piece)
    if key not in _cache:
        _cache[key] = Encoder(data, piece)
    return _cache[key]


def _shared(spark: SparkSession, folder: str | None):
    """The vocabulary as a broadcast (0.8 MB): only the driver needs the file."""
    return spark.sparkContext.broadcast(vocabulary(folder or spark.conf.get(FOLDER_SETTING, TOKENIZERS)))


def _lists(values: list[list[int]]) -> tuple[pa.Array, "object"]:
    import numpy as np

    sizes = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.fromiter((x for ids in values for x in ids), np.int32, int(sizes.sum()))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, flat), sizes


def _encode_batches(data, piece: int, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(data.value, piece)
        for batch in batches:
            if batch.num_rows:
                ids, sizes = _lists([e.encode(t) if t else [] for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes) if count_only else ids], names=["_id", "n_tokens" if count_only else "ids"])

    return run


def _cut_batches(data, piece: int, leaf: int, id_type: pa.DataType):
    schema = pa.schema([("_id", id_type), ("_hash", pa.string()), ("_place", pa.int32()), ("_part", pa.int32()), ("_whole", pa.bool_()), ("_bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(data.value, piece)
        for batch in batches:
            for k in range(batch.num_rows):
                i, h = batch.column(0).slice(k, 1), batch.column(1)[k].as_py()
                rows = list(e.leaves(batch.column(2)[k].as_py(), leaf))
                n = len(rows)
                if n:
                    cols = [pa.array([x[c] for x in rows], schema.field(c + 2).type) for c in range(4)]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([i] * n), pa.array([h] * n, pa.string()), *cols], schema=schema)

    return run


def _leaf_batches(data, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(data.value, piece)
        for batch in batches:
            if batch.num_rows:
                ids, _ = _lists([e.leaf_ids(w, b) for w, b in zip(batch.column("_whole").to_pylist(), batch.column("_bytes").to_pylist())])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_id", "_hash", "_place", "_part")], ids], names=["_id", "_hash", "_place", "_part", "_leaf"])

    return run


def _join_batches(data, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(data.value, piece)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, out = [], []
            for k, leaves in enumerate(batch.column("_leaves").to_pylist()):
                once = {(x["_place"], x["_part"]): x["_leaf"] for x in leaves}
                ids = e.concatenate([(*p, v) for p, v in once.items()])
                copies = len(leaves) // len(once)  # repeated rows cut alike
                at += [k] * copies
                out += [ids] * copies
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(at)), _lists(out)[0]], names=["_id", "ids"])

    return run


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, leaf: int = LEAF, piece: int = PIECE) -> DataFrame:
    """(id, ids array<int>), one row per input row, without special tokens.

    Null and empty texts give an empty list.  Strings that look like control tokens are ordinary
    text.  Other columns are ignored; repeated rows give repeated rows.
    """
    data = _shared(df.sparkSession, folder)
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType
    name = kind.simpleString()
    short = spread(src.where(F.col("_text").isNull() | (F.length("_text") <= leaf)))
    done = short.mapInArrow(_encode_batches(data, piece, False), f"_id {name}, ids array<int>")
    return done.unionByName(_tree_ids(src, data, kind, leaf, piece)).withColumnRenamed("_id", id_col)


def _tree_ids(src: DataFrame, data, kind, leaf: int, piece: int) -> DataFrame:
    """The texts over a leaf: cut, leaves encoded wherever there is a free core, joined per text.  A text
    is known by its id and hash, so that a repeated attempt finds the same leaves."""
    name = kind.simpleString()
    long = src.where(F.length("_text") > leaf).select("_id", F.md5("_text").alias("_hash"), "_text")
    leaves = long.mapInArrow(_cut_batches(data, piece, leaf, to_arrow_type(kind)), f"_id {name}, _hash string, _place int, _part int, _whole boolean, _bytes binary")
    coded = leaves.repartition("_hash", "_place", "_part").mapInArrow(_leaf_batches(data, piece), f"_id {name}, _hash string, _place int, _part int, _leaf array<int>")
    # the leaves of one document, whose ids are one value in any case
    own = coded.groupBy("_id", "_hash").agg(F.collect_list(F.struct("_place", "_part", "_leaf")).alias("_leaves"))
    return own.mapInArrow(_join_batches(data, piece), f"_id {name}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, leaf: int = LEAF, piece: int = PIECE) -> DataFrame:
    """(id, n_tokens), one row per input row; null and empty texts have 0.

    Long texts are encoded by the same tree; only a number leaves it."""
    data = _shared(df.sparkSession, folder)
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType
    short = spread(src.where(F.col("_text").isNull() | (F.length("_text") <= leaf)))
    done = short.mapInArrow(_encode_batches(data, piece, True), f"_id {kind.simpleString()}, n_tokens long")
    long = _tree_ids(src, data, kind, leaf, piece).select("_id", F.size("ids").cast("long").alias("n_tokens"))
    return done.unionByName(long).withColumnRenamed("_id", id_col)
