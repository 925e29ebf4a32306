"""Language-model scores of documents: a word-count base and a causal attention model.

Counts cover all training documents and stay distributed: of words, of ids, of ids beside
each other, of cells after inputs (``attention``), and of passages (``passages``). The
commonest words, a fixed number of them, are looked up where a text is scored; the rest
are joined. The attention model starts from those counts; the fit of its layers begins on a
bounded sample and goes through all training documents. It scores the subword ids of every whole text, and shares each stretch of
them with the memory of passages, which knows what occurs elsewhere in the training
documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm import attention, passages, scan, training
from quarry.llm.packing import Encoder, distinct
from quarry.llm.shared import over_batches, stored, tuned

#: Words that are looked up without a join: so many, however large the corpus (16 bytes each).
COMMON = 1 << 19
#: Bounds of the sample where the fit of the attention model's layers begins.
SAMPLE_ROWS, SAMPLE_BYTES = 2_500, 8 << 20
#: Ids that one pass of the layers' fit goes through, about, and rounds of such passes.
SHARD_IDS, ROUNDS = 1 << 20, 4
#: Parts in which sums of long rows of numbers are added up, each by a task of its own if need be.
PARTS = 1024
#: Bytes of ids that are counted together.
TOGETHER = 4 << 20
#: Distinct words that a counting task holds before it passes them on.
HELD = 1 << 20
#: Hash of the end of a text, as a word.
END = np.uint64(0x0123456789ABCDEF)


def _lowered(t: scan.Texts) -> scan.Texts:
    return scan.Texts(scan.lowered(t.data, latin=False), t.offsets)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): occurrences of each word's 64-bit hash, and of the end, one a text; a null text is empty."""
    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, ends, held = [], [], 0, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            both, n = np.concatenate(words), np.concatenate(counts)
            order = np.argsort(both)
            both, n = both[order], n[order]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
            return both[first], np.add.reduceat(n, first) if len(first) else n

        def out(w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for batch in batches:
            for _, _, t in scan.texts_of(batch.column(0)):
                w, n = np.unique(_lowered(t).word_hashes(), return_counts=True)
                words.append(w)
                counts.append(n)
                ends, held = ends + t.n, held + len(w)
            if held >= 2 * HELD:
                words, counts = ([x] for x in merged())
                held = len(words[0])
                if held >= HELD:
                    yield out(words[0], counts[0])
                    words, counts, held = [], [], 0
        words.append(np.array([END]))
        counts.append(np.array([ends]))
        yield out(*merged())

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _common(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the commonest words, by hash: at most ``most``, whatever the corpus.

    They are those over a count, which a histogram of sixteen steps to a doubling finds:
    nothing is sorted, and no task sees more than its share.
    """
    step = F.floor(F.log2("n") * 16)
    room, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # about a thousand rows
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    got = counts.where(step >= least if least is not None else F.lit(False)).toArrow()
    words, n = got["word"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(words)
    return words[order], n[order]


def _lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


_LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def _kind(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def _ids(column: pa.Array, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _added(rows: DataFrame, size: int, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray], number: str = "<i8") -> np.ndarray:
    """The ``sums`` of the tasks' rows added up: ``size`` numbers, whatever the corpus.

    Each task hands on one row of numbers in PARTS parts, which executors add up.
    """
    cuts = np.linspace(0, size, PARTS + 1).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sums(batches)
        parts = [(k, total[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if total[a:b].any()]
        yield out([k for k, _ in parts], [x for _, x in parts])

    def out(parts: Iterable[int], sums: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(x.astype(number).tobytes(), 1) for x in sums], pa.binary())], ["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(x), number)
                sums[part] = sums[part] + x if part in sums else x
        yield out(sums, list(sums.values()))

    schema = "part int, sums binary"
    total = np.zeros(size, number)
    for r in rows.mapInArrow(run, schema).repartition("part").mapInArrow(add, schema).collect():  # PARTS rows
        total[cuts[r.part] : cuts[r.part + 1]] += np.frombuffer(zlib.decompress(bytes(r.sums)), number)
    return total


def _totals(ids: DataFrame, size: int, count: Callable[[list[np.ndarray]], np.ndarray], kind: np.dtype) -> np.ndarray:
    """Sums over all rows of ``ids`` of ``count`` of some rows: ``size`` numbers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, held, n = np.zeros(size, np.int64), [], 0
        for batch in batches:
            held += _ids(batch.column(0), kind)
            n += batch.nbytes
            if n >= TOGETHER:
                total += count(held)
                held, n = [], 0
        return total + count(held) if held else total

    return _added(ids.select("ids"), size, sums)


def classes_of(ids: DataFrame, vocabulary: int) -> attention.Classes:
    """``attention.classes`` of all rows of ``ids`` (binary column ``ids``)."""
    kind = _kind(vocabulary + 1)
    flat = lambda rows: attention.flat(rows, vocabulary)
    counts = _totals(ids, vocabulary + 1, lambda rows: np.bincount(flat(rows), minlength=vocabulary + 1), kind)
    size = len(attention.neighbours(np.zeros(0, np.int64), counts))
    before = lambda rows: attention.neighbours(np.append(vocabulary, flat(rows)), counts) if rows else np.zeros(size, np.int64)
    c = attention.arranged(counts, _totals(ids, size, before, kind))
    after = lambda rows: attention.pairs(flat(rows), c) if rows else np.zeros(attention.CELLS, np.int64)
    return attention.followed(c, _totals(ids, attention.CELLS, after, kind))


def learn(ids: DataFrame, model: attention.Model, kind: np.dtype, shard_ids: int = SHARD_IDS) -> None:
    """Fits the layers of ``model`` further on all rows of ``ids`` (``doc_id``, ``ids``), each once.

    A hash deals the rows into shards of about ``shard_ids`` ids, as many as it takes, and
    the shards into at most ROUNDS rounds. In a round, each shard's pass begins at the same
    model, and their mean, weighted by ids, is where the next round begins. So the result
    doesn't follow the partitions. A shard that turns out long is passed through in parts.
    """
    size, rows = ids.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)), F.count("*")).first()
    shards = -(-(size // kind.itemsize + rows) // shard_ids)  # with the ends
    hashed = ids.select(F.xxhash64("doc_id", "ids").alias("hash"), "ids").withColumn("shard", F.pmod("hash", F.lit(max(shards, 1))))
    rounds = min(ROUNDS, shards)
    for k in range(rounds):
        start = model.numbers()

        def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total, held, n, last = np.zeros(len(start) + 1), [], 0, None

            def through() -> None:
                model.put(start)
                attention.passed(model, held)
                total[:-1] += n * (model.numbers() - start)
                total[-1] += n

            for batch in batches:
                for shard, x in zip(batch.column(0).to_pylist(), _ids(batch.column(1), kind), strict=True):
                    if n and (shard != last or n >= 2 * shard_ids):
                        through()
                        held, n = [], 0
                    held.append(x)
                    n, last = n + len(x) + 1, shard
            if n:
                through()
            return total

        dealt = hashed.where(F.pmod("shard", F.lit(rounds)) == k).repartition(max(shards // rounds, 1), "shard").sortWithinPartitions("shard", "hash").select("shard", "ids")
        total = _added(dealt, len(start) + 1, sums, "<f8")
        model.put(start + total[:-1] / max(total[-1], 1))


def looked_up(docs: DataFrame, train: Column, tokenizer: str, words: np.ndarray, n: np.ndarray, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, and row, train, n_tokens, known and gain by the given words, the rare ones, ids."""
    keep = [c for c in docs.columns if c != text]
    source = docs.select(F.monotonically_increasing_id().alias("__row"), F.coalesce(train, F.lit(False)).alias("__train"), *[docs[c] for c in keep], docs[text].alias("__text"))
    names = source.columns[:-1]
    gain = np.log10(n + 1.0)
    encoders: dict[str, Encoder] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if tokenizer not in encoders:
            encoders[tokenizer] = Encoder(tokenizer)
        encode = encoders[tokenizer]
        kind = _kind(encode.plain.get_vocab_size() + 1)
        n_tokens, known, gains, ids, rare, rare_sizes = [], [], [], [], [], []
        for _, _, t in scan.texts_of(batch.column(batch.num_columns - 1), 4 << 20):
            t = _lowered(t)
            hashes = t.word_hashes()
            some, which = distinct(hashes)
            end = np.searchsorted(words, END)
            has_end = end < len(words) and words[end] == END
            at = np.minimum(np.searchsorted(words, hashes[some]), max(len(words) - 1, 0))
            found = words[at] == hashes[some] if len(words) else np.zeros(len(some), bool)
            on = found[which]
            n_tokens.append(t.n_words + 1)
            known.append(np.bincount(t.doc, on, t.n).astype(np.int64) + has_end)
            gains.append(np.bincount(t.doc, np.where(found, gain[at], 0.0)[which] if len(words) else None, t.n) * (len(words) > 0) + (gain[end] if has_end else 0.0))
            rare.append(hashes[~on].view(np.int64))
            rare_sizes.append(np.bincount(t.doc[~on], minlength=t.n))
            ids += [x.astype(kind).tobytes() for x in encode.each(t)]
        sizes = np.concatenate([[0], *rare_sizes]).cumsum().astype(np.int32)
        arrays = [
            pa.array(np.concatenate(n_tokens).astype(np.int64)), pa.array(np.concatenate(known).astype(np.int64)), pa.array(np.concatenate(gains)),
            pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(rare))), pa.array(ids, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*names, "n_tokens", "__known", "__gain", "__rare", "ids"])

    added = StructType.fromDDL("n_tokens long, __known long, __gain double, __rare array<long>, ids binary")
    return over_batches(source, work, StructType([*source.drop("__text").schema.fields, *added.fields]))


def judged(ids: DataFrame, model: attention.Model, kind: np.dtype) -> DataFrame:
    """(__row, __train, total, stretches): log10 by the attention model of each row of ids, and of its stretches.

    A stretch has its hash, how often its text has it, and its own log10.
    """
    end = model.classes.end

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = _ids(batch.column(2), kind)
        row = attention.flat(texts, end)
        stops = np.cumsum([len(x) + 1 for x in texts])
        starts, hashes = passages.cut(row, stops - 1, end)
        sums = np.add.reduceat(model.each(texts).astype(np.float64), starts) / np.log(10)
        text = np.searchsorted(stops, starts, "right")
        many = np.bincount(text, minlength=len(texts))
        fields = [pa.array(hashes.view(np.int64)), pa.array(passages.multiplicities(text, hashes).astype(np.int32)), pa.array(sums.astype(np.float32))]
        stretches = pa.StructArray.from_arrays(fields, ["hash", "own", "other"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), stretches)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.bincount(text, sums, len(texts))), lists], ["__row", "__train", "total", "stretches"])

    return over_batches(ids.select("__row", "__train", "ids"), work, "__row long, __train boolean, total double, stretches array<struct<hash:long,own:int,other:float>>")


def remembered(found: DataFrame) -> DataFrame:
    """(__row, score) of ``judged`` rows (stored): each stretch shared with the memory of passages.

    A text's own occurrences never count for it, in or out of the training documents, so
    that what is scored apart is what occurs elsewhere.
    """
    each = found.select("__row", "__train", F.explode("stretches").alias("s")).select("__row", "__train", "s.*")
    counts = stored(each.where("__train").groupBy("hash").agg(F.count("*").alias("n")), "lm-passages")
    totals = passages.totals(counts)
    # what occurs once can't be met again in a training text: only held-out texts look for it
    trained = each.where("__train").join(counts.where("n > 1").hint("merge"), "hash").withColumn("others", F.col("n") - F.col("own"))
    met = trained.unionByName(each.where("NOT __train").join(counts.hint("merge"), "hash").withColumn("others", F.col("n"))).where("others > 0")
    gains = met.groupBy("__row").agg(F.sum(totals.gain(F.col("others"), F.col("other").cast("double"))).alias("more"))
    plain = F.col("total") + F.size("stretches") * F.lit(float(np.log10(totals.left)))
    return found.join(gains, "__row", "left").select("__row", (plain + F.coalesce("more", F.lit(0.0))).alias("score"))


def scored(docs: DataFrame, train: Column, tokenizer: str, text: str = "text", common: int = COMMON, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Columns of ``docs`` but the text, and n_tokens, n_known, train_tokens, base_score, score.

    ``docs`` has ``doc_id``; rows where ``train`` holds are learnt from. Only A-Z are
    lower-cased. A null text is empty: its one token is the end. Without training rows the
    counts are 0. Rows are scored alone, so repeated rows get equal scores; columns named
    like a result are replaced. A training document's own passages don't speak for it.
    """
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    source = docs.select(*[docs[c] for c in docs.columns if c.lower() not in results])
    keep = [c for c in source.columns if c != text]
    counts = stored(word_counts(docs.where(train), text), "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    per_token = float(np.log10(total + distinct + 1))
    own = stored(looked_up(source, train, tokenizer, *_common(counts, common), text), "lm-ids")  # row numbers are fixed from here

    sample = training.sample(docs.select("doc_id", F.col(text).alias("text"), F.lit(1).alias("one")), None, "one", train, rows, text_bytes)
    encode = Encoder(tokenizer)
    vocabulary = encode.plain.get_vocab_size()
    model = attention.trained([encode(_lower(x)) for x in sample["text"].to_pylist()], classes_of(own.where("__train"), vocabulary))
    del sample, encode
    kind = _kind(vocabulary + 1)
    learn(own.where("__train"), model, kind)
    training.released()
    scores = remembered(stored(judged(own, model, kind), "lm-judged"))

    rare = own.select("__row", F.explode("__rare").alias("word")).join(counts.hint("merge"), "word")
    more = rare.groupBy("__row").agg(F.count("*").alias("__more"), F.sum(F.log10(F.col("n") + 1.0)).alias("__more_gain"))
    joined = own.drop("__rare", "ids").join(more, "__row", "left").join(scores, "__row")
    base = F.col("__gain") + F.coalesce("__more_gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)
    return joined.select(*keep, "n_tokens", (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
