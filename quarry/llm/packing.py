"""Best-two-fit packing of documents into sequences.

A sequence is filled greedily, longest piece first; then its shortest piece gives way to
two unpacked ones that together fit the widened gap more tightly. Only lengths matter, so
the plan is made on counts by length: as long as the counts of the lengths that a
sequence uses last, the next sequence comes out alike, and all such are made at once.
The driver sees one count for each length and group; pieces find their place by rank.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm import scan
from quarry.llm.shared import over_batches, stored

CAPACITY, END_ID = 2048, 0
#: Pieces of a length are ranked in groups of about 1/GROUPS of all, however common the length.
GROUPS = 4096
#: Fixed value: how byte-level BPE files of this kind split a text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of more than one byte, in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LATIN = re.compile("[\0-\u024f]*").fullmatch


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level BPE file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _by_rank(tokenizer, model: dict):  # noqa: ANN001, ANN202
    """A tiktoken encoder that merges by the tokens' ids; None where that may differ from the file's merges.

    The two agree if merges make tokens in the order of their ids, one merge a token, and
    each token alone comes out as itself. For then, where two neighbours make up a token
    t, all merges so far within t's stretch are those that t alone undergoes, and the next
    of these joins the two.
    """
    import tiktoken

    vocabulary, names = model["vocab"], _byte_names()
    made = [vocabulary.get("".join(x) if isinstance(x, list) else x.replace(" ", "", 1)) for x in model["merges"]]
    ordered = None not in made and all(a < b for a, b in zip(made, made[1:], strict=False))
    whole = ordered and all(c in names for token in vocabulary for c in token) and len(made) + 256 == len(vocabulary)
    if not whole or any(len(tokenizer.model.tokenize(token)) != 1 for token in vocabulary):
        return None
    ranks = {bytes(names[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, the number of each place's key among them)."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    unit = np.empty(len(keys), np.int64)
    unit[order] = np.cumsum(new) - 1
    return order[new], unit


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file, without added special tokens.

    Where the file has the usual byte-level rule, no piece of a text reaches from a word
    into the white space behind it, and of that before it only one space belongs to the
    word. So a word's ids depend on nothing else: of many texts each distinct word is encoded
    once, and the ids are put together in numpy. Texts with special tokens or with
    white space of several bytes go the plain way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.plain.get_added_tokens_decoder().values()]
        own = json.loads(self.plain.to_str())
        rule, model = own["pre_tokenizer"] or {}, own["model"]
        usual = rule.get("type") == "ByteLevel" and not rule.get("add_prefix_space") and rule.get("use_regex", True) and own["normalizer"] is None
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self.fast = _by_rank(self.plain, model) if usual and plain else None
        self.sizes = np.array([len(self.fast.decode_single_token_bytes(i)) for i in range(self.fast.n_vocab)]) if self.fast else None  # bytes of each id

    def __call__(self, text: str) -> np.ndarray:
        return next(self.each(next(scan.texts_of(pa.array([text], pa.large_string()), 1 << 60))[2]))

    def _plainly(self, text: str) -> np.ndarray:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)

    def _space(self, space: bytes, bare_word: bool) -> np.ndarray:
        """White space that belongs to no word: one piece, but for its last sign right before a word."""
        parts = [space[:-1], space[-1:]] if bare_word and len(space) > 1 else [space]
        return np.concatenate([self._plainly(x.decode()) for x in parts])

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in a row, where each part's end); a part begins with white space and has no other before a word."""
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text = b"".join(parts).decode()
        ends = np.cumsum([len(x) for x in parts])
        if not _LATIN(text):
            ids = [self.plain.encode(x.decode(), add_special_tokens=False).ids for x in parts]
            return np.array([i for x in ids for i in x], np.uint32), np.cumsum([len(x) for x in ids])
        ids = self.fast.encode_to_numpy(text, disallowed_special=())
        return ids, np.searchsorted(np.cumsum(self.sizes[ids]), ends, "right")

    def each(self, t: scan.Texts) -> Iterator[np.ndarray]:
        """The ids of each text of ``t``, whose words lie between ASCII white space."""
        data = t.data.tobytes()
        if self.fast is None:
            for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True):
                yield self._plainly(data[a:b].decode())
            return
        odd = np.zeros(t.n, bool)
        for place in [*(m.start() for m in _WIDE_SPACE.finditer(data)), *(m.start() for x in self.special for m in re.finditer(re.escape(x), data))]:
            odd[np.searchsorted(t.offsets, place, "right") - 1] = True

        worded = t.n_words > 0
        before = np.concatenate([[0], t.ends])[: len(t.starts)]  # where the word before ends, or the text begins
        before[t.bounds[:-1][worded]] = t.offsets[:-1][worded]
        spaced = (t.starts > before) & (t.data[np.maximum(t.starts, 1) - 1] == 0x20) if len(t.data) else np.zeros(0, bool)
        begin = t.starts - spaced
        first, unit = distinct(scan.mixed(t.word_hashes() + spaced.astype(np.uint64)))
        # words without a space of their own get a line break, whose id is dropped
        bare = ~spaced[first]
        parts = [b"\n" + data[a:b] if c else data[a:b] for a, b, c in zip(begin[first].tolist(), t.ends[first].tolist(), bare.tolist(), strict=True)]
        store, ends = self._encoded(parts)
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)] + bare
        sizes = ends - starts

        # white space of its own: before a word, or at the end of a text
        at = np.flatnonzero(begin > before)
        last = np.where(worded, np.concatenate([[0], t.ends])[t.bounds[1:]], t.offsets[:-1])
        tail = np.flatnonzero(t.offsets[1:] > last)
        spaces: dict[tuple[bytes, bool], int] = {}
        number = [spaces.setdefault((data[a:b], c), len(spaces)) for a, b, c in zip(np.concatenate([before[at], last[tail]]).tolist(), np.concatenate([begin[at], t.offsets[1:][tail]]).tolist(), np.concatenate([~spaced[at], np.zeros(len(tail), bool)]).tolist(), strict=True)]
        own = [self._space(*x) for x in spaces]
        where, owner = np.concatenate([at, t.bounds[1:][tail]]), np.concatenate([t.doc[at], tail])
        order = np.lexsort((owner, where))
        unit = np.insert(unit, where[order], len(parts) + np.array(number, np.int64)[order])
        sizes = np.concatenate([sizes, [len(x) for x in own]]).astype(np.int64)
        starts = np.concatenate([starts, len(store) + np.cumsum([0, *(len(x) for x in own)])[:-1]]).astype(np.int64)
        store = np.concatenate([store, *own]).astype(np.uint32)

        length = sizes[unit]
        ends = np.cumsum(length)
        ids = store[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[unit] - (ends - length), length)]
        units = np.concatenate([[0], np.cumsum(t.n_words + np.bincount(owner, minlength=t.n))])
        cuts = np.concatenate([[0], ends])[units]
        for k in range(t.n):
            if odd[k]:
                yield self._plainly(data[t.offsets[k] : t.offsets[k + 1]].decode())
            else:
                yield ids[cuts[k] : cuts[k + 1]]


def cut(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; only the first may be short."""
    first = n % capacity or min(n, capacity)
    start, length = 0, first
    while start < n:
        yield start, length
        start, length = start + length, capacity


PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece, with the other columns of ``docs``, and ``ids`` if asked for.

    A null text is empty; an empty text is its end id alone. Columns of ``docs`` named like
    a piece's column are replaced. Repeated rows are pieces of their own.
    """
    added = StructType.fromDDL(PIECE + (", ids array<int>" if with_ids else ""))
    keep = [c for c in docs.columns if c != text and c.lower() not in {*added.names, "sequence_id", "offset"}]
    source = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    encoders: dict[str, Encoder] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if tokenizer not in encoders:
            encoders[tokenizer] = Encoder(tokenizer)
        row, out = [], []
        texts = (x for _, _, t in scan.texts_of(batch.column(batch.num_columns - 1)) for x in encoders[tokenizer].each(t))
        for i, x in enumerate(texts):
            ids = np.append(x, END_ID).astype("<u4")
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                own = ids[start : start + length]
                row.append(i)
                out.append((k, start, length, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if with_ids else [])))
        at = pa.array(row, pa.int64())
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        arrays = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=False)]
        return pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), *arrays], [*keep, *added.names])

    return over_batches(source, work, StructType([*(source.schema[c] for c in keep), *added.fields]))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence's pieces, number of such sequences), by best-two-fit."""
    left = {k: n for k, n in counts.items() if n > 0}
    free = sum(1 << k for k in left)  # a bit for each length with unpacked pieces
    out = []
    while left:
        used: list[int] = []
        open_, spare, gap = free, dict(), capacity

        def take(k: int) -> None:
            nonlocal open_
            used.append(k)
            spare[k] = spare.get(k, left[k]) - 1
            if not spare[k]:
                open_ &= ~(1 << k)

        while best := (open_ & ((2 << gap) - 1)).bit_length() - 1:
            if best < 0:
                break
            take(best)
            gap -= best
        if gap and used:
            shortest = used[-1]
            room, pair, fill = gap + shortest, None, shortest
            rest = open_ & ((2 << room) - 1)
            while rest and fill < room:
                a = rest.bit_length() - 1
                rest ^= 1 << a
                if 2 * a <= fill:
                    break
                others = open_ if spare.get(a, left[a]) > 1 else open_ & ~(1 << a)
                b = (others & ((2 << (room - a)) - 1) & ((2 << a) - 1)).bit_length() - 1
                if b > 0 and a + b > fill:
                    pair, fill = (a, b), a + b
            if pair:
                used.pop()
                spare[shortest] += 1
                open_ |= 1 << shortest
                take(pair[0])
                take(pair[1])
        need = {k: used.count(k) for k in set(used)}
        times = min(left[k] // n for k, n in need.items())
        out.append((used, times))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
                free &= ~(1 << k)
    return out


def _places(packed: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where the pieces of each length go by rank."""
    rows, next_rank, sequence = [], {}, 0
    for used, times in packed:
        offset = 0
        for k in used:
            rank = next_rank.get(k, 0)
            rows.append((k, rank, sequence, offset))
            next_rank[k] = rank + times
            offset += k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def packed(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces`` (from ``pieces``, stored) with ``sequence_id`` and ``offset``.

    Which piece of several of one length goes where follows a hash of its columns. An
    empty table gives an empty result.
    """
    spark = cut_pieces.sparkSession
    counts = {r.length: r.n for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row a length: at most ``capacity``
    total = max(sum(counts.values()), 1)
    sizes = spark.createDataFrame([(k, -(-n * GROUPS // total)) for k, n in sorted(counts.items())], "length long, __groups long")
    mark = F.xxhash64(*[c for c, kind in cut_pieces.dtypes if c != "ids" and not kind.startswith("map")])
    dealt = cut_pieces.join(F.broadcast(sizes), "length").withColumn("__mark", mark).withColumn("__group", F.pmod("__mark", "__groups"))
    group_sizes = dealt.groupBy("length", "__group").agg(F.count("*").alias("n")).collect()  # at most GROUPS + ``capacity`` rows
    before, sums = [], {}
    for r in sorted(group_sizes):
        before.append((r.length, r["__group"], sums.get(r.length, 0)))
        sums[r.length] = sums.get(r.length, 0) + r.n
    first = spark.createDataFrame(before, "length long, __group long, __before long")
    order = Window.partitionBy("length", "__group").orderBy("__mark", *[c for c in ("piece", "start", "ids_crc32")])
    ranked = dealt.withColumn("__in", F.row_number().over(order)).join(F.broadcast(first), ["length", "__group"])
    ranked = ranked.select(*cut_pieces.columns, (F.col("__before") + F.col("__in") - 1).alias("__rank"))
    places = _places(plan(counts, capacity))
    keys = places[:, 0] * (1 << 48) + places[:, 1]
    names = [*cut_pieces.columns, "sequence_id", "offset"]
    at = cut_pieces.columns.index("length")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank = batch.column(batch.num_columns - 1).to_numpy().astype(np.int64)
        own = batch.column(at).to_numpy() * (1 << 48) + rank
        hit = places[np.searchsorted(keys, own, "right") - 1]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hit[:, 2] + rank - hit[:, 1]), pa.array(hit[:, 3])], names)

    return over_batches(ranked, work, StructType([*cut_pieces.schema.fields]).add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents to placed pieces: see ``pieces`` and ``packed``. Tokenised once, into a stored table."""
    return packed(stored(pieces(docs, tokenizer, capacity, text, with_ids), "pieces"), capacity)
