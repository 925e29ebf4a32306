"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark the windows that occur twice or more in
a text; the share of its word characters inside them, and inside repeated lines, is
held against a limit for each length. Nothing else but the base rule rejects a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from quarry.llm import scan
from quarry.llm.shared import over_batches

#: Most word characters of a text inside repeated n-grams, in percent by n, beyond ALLOWANCE
#: characters: the longer a text, the less a heading that stands above and below it weighs.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
ALLOWANCE = 60
#: Most word characters, in percent, inside lines that repeat an earlier one, beyond LINE_ALLOWANCE.
LINE_LIMIT, LINE_ALLOWANCE = 15, 30
MIN_WORDS = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_char_share double, dup_ngram_shares array<double>"


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def _lines(t: scan.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, text number and whether it repeats, of the lines with a word."""
    breaks = np.flatnonzero(t.data == 0x0A)
    starts = np.concatenate([t.offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, t.offsets[1:]])
    starts.sort()
    # a break ends its own text's line; a text's end ends its last: one end for each start
    ends.sort()
    wordy = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    starts, ends = starts[wordy], ends[wordy]
    doc = np.searchsorted(t.offsets, starts, "right") - 1
    key = scan.mixed(t.hashes(starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:][key[order[1:]] == key[order[:-1]]]] = True
    return starts, ends, doc, again


def measures(t: scan.Texts, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """Counts and shares for each text of ``t``."""
    chars = t.characters()
    sizes = chars[t.ends] - chars[t.starts]
    n, n_words = len(t.starts), t.n_words
    word_chars = _sums(sizes, t.bounds)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": t.per_text(_SYMBOL[t.data])}
    starts, ends, doc, again = _lines(t)
    out["n_dup_lines"] = np.bincount(doc, again, t.n).astype(np.int64)
    line_words = np.concatenate([[0], np.cumsum(sizes)])
    line_chars = line_words[np.searchsorted(t.starts, ends)] - line_words[np.searchsorted(t.starts, starts)]
    out["dup_line_chars"] = np.bincount(doc, line_chars * again, t.n).astype(np.int64)

    words = t.word_hashes()
    doc_key = scan.mixed(t.doc.astype(np.uint64) + np.uint64(1))
    rolling = words + doc_key
    at = np.arange(n)  # windows that may repeat: a repeated n-gram begins with a repeated (n-1)-gram
    left = t.bounds[1:][t.doc] - at  # words from here to the text's end
    factor = np.uint64(1)
    inside_chars = {}
    for width in range(2, max(lengths) + 1):
        factor = np.uint64(int(factor) * 0xD6E8FEB86659FD93 % 2**64)
        at = at[left[at] >= width]
        rolling[at] += words[at + width - 1] * factor
        if width >= 3:
            at = at[scan.repeated(scan.mixed(rolling[at]))]
        if width == 3 or width in lengths:
            inside = scan.covered(at, width, n)
            if width == 3:
                out["n_repeat_words"] = _sums(inside, t.bounds)
            if width in lengths:
                inside_chars[width] = _sums(sizes * inside, t.bounds)
    out["dup_ngram_chars"] = np.stack([inside_chars[w] for w in lengths], 1) if n else np.zeros((t.n, len(lengths)), np.int64)
    out.setdefault("n_repeat_words", np.zeros(t.n, np.int64))
    return out


def verdicts(m: dict[str, np.ndarray], limits: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(base failed, kept): kept if neither the base rule nor a limit of coverage is overrun."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    bad = (100 * (m["dup_ngram_chars"] - ALLOWANCE) > np.array(list(limits.values())) * m["word_chars"][:, None]).any(1)
    bad |= 100 * (m["dup_line_chars"] - LINE_ALLOWANCE) > LINE_LIMIT * m["word_chars"]
    return failed, ~failed & ~bad


def measure(docs: DataFrame, text: str = "text", limits: dict[int, int] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all but the text by default) with the measures and the verdict.

    Each row is judged alone: no shuffle, and repeated rows get equal results. A null
    text reads as empty; empty texts have no words and fail the base rule. Columns of
    ``docs`` named like a result give way to it. Texts of any length are read whole.
    ``limits`` are percents by n-gram length.
    """
    limits = limits or NGRAM_LIMITS
    names = {f.name for f in StructType.fromDDL(COLUMNS)}
    keep = [c for c in docs.columns if c.lower() not in names and c != text] if keep is None else keep
    source = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for _, _, t in scan.texts_of(batch.column(batch.num_columns - 1)):
            m = measures(t, tuple(limits))
            failed, kept = verdicts(m, limits)
            parts.append([*(m[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, kept, m["dup_line_chars"] / np.maximum(m["word_chars"], 1), m["dup_ngram_chars"] / np.maximum(m["word_chars"], 1)[:, None]])
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        shares = columns.pop()
        arrays = [pa.array(x) for x in columns]
        arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(shares) + 1, dtype=np.int32) * shares.shape[1], pa.int32()), pa.array(shares.ravel())))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*keep, *(c.split()[0] for c in COLUMNS.split(", "))])

    schema = StructType([*(source.schema[c] for c in keep), *StructType.fromDDL(COLUMNS)])
    return over_batches(source, work, schema)


def kept_rows(docs: DataFrame, text: str = "text", limits: dict[int, int] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns unchanged."""
    limits = limits or NGRAM_LIMITS
    at = docs.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [verdicts(measures(t, tuple(limits)), limits)[1] for _, _, t in scan.texts_of(batch.column(at))]
        return batch.filter(pa.array(np.concatenate(kept)))

    return over_batches(docs, work, docs.schema)


#: What ``measure(documents, keep=["doc_id"])`` returns, for DuckDB; ids must be distinct.
SQL = """
WITH toks AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), pos AS (
  SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM toks
), grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM pos, (VALUES (3), (5), (6), (7), (8), (9), (10)) AS t(k) WHERE i + k - 1 <= n
), again AS (
  SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS j FROM again
), inside AS (
  SELECT c.doc_id, k, count(*) AS words, sum(length(w[j])) AS chars FROM covered c JOIN toks t ON t.doc_id = c.doc_id GROUP BY 1, 2
), split_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM toks
), lines AS (
  SELECT doc_id, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY nr) > 1 AS again
  FROM split_lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), line_sums AS (
  SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (again), 0) AS dup_chars FROM lines GROUP BY 1
), facts AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(dup_chars, 0) AS dup_chars,
         coalesce((SELECT words FROM inside s WHERE s.doc_id = t.doc_id AND k = 3), 0)::BIGINT AS n_repeat_words,
         list_transform([5, 6, 7, 8, 9, 10], lambda x: coalesce(m[x], 0)) AS counts
  FROM toks t LEFT JOIN line_sums l ON l.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, map_from_entries(list((k, chars))) AS m FROM inside GROUP BY 1) s ON s.doc_id = t.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, dup_chars::DOUBLE / greatest(word_chars, 1) AS dup_line_char_share FROM facts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 100 * (dup_chars - 30) > 15 * word_chars AND NOT list_bool_or(list_transform(range(1, 7), lambda i: 100 * (counts[i] - 60) > (16 - i) * word_chars)) AS kept,
       dup_line_char_share, list_transform(counts, lambda x: x::DOUBLE / greatest(word_chars, 1)) AS dup_ngram_shares
FROM judged
"""
