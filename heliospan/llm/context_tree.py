"""Language-model scores of texts by context-tree weighting over bytes.

Every byte is decomposed into eight binary choices. Each choice has a tree of byte
contexts up to ``DEPTH`` bytes long, and each context a Krichevsky-Trofimov estimate
from the counts of all training texts. A context is weighted against the product of
its longer contexts by how well either explains the training bytes, so all depths
are mixed; the sum of the logarithms gives the code length of every byte.

Blocks of text ask for the runs of ``DEPTH`` + 1 bytes they hold (see ``exchange``),
once to build the trees and once to be scored. Runs are dealt by the last two bytes
of their context, so a bucket holds whole subtrees; the two upper levels are sums
over buckets with at most 256 * 255 + 255 nodes, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospan.llm import exchange
from heliospan.llm.common import gathered, materialize, prepared
from heliospan.llm.exchange import values
from heliospan.llm.words import IS_SPACE, LOWER, parts, span_hashes, split_words

DEPTH = 5
# No byte of UTF-8: it stands before every text and ends it.
EDGE = 0xFF
# Sums of logarithms over buckets are taken in fixed point, so that no order changes them.
FIXED = 1 << 20
# An odd factor permutes the pairs of last bytes, so that buckets get unlike ones, and its inverse.
_SPREAD, _UNSPREAD = 40503, pow(40503, -1, 1 << 16)
_NEXT_AT = 8 * (7 - DEPTH)

TEXTS = ("block BIGINT, data BINARY, offsets BINARY, prior BINARY, ended BOOLEAN, "
         "uid ARRAY<BIGINT>, doc_id ARRAY<BIGINT>, held ARRAY<BOOLEAN>")
ANSWERS = "block BIGINT, bucket INT, kind INT, answer BINARY"
PARTS = ("uid BIGINT, doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, n_bytes BIGINT, "
         "base_score DOUBLE, score DOUBLE")


def text_blocks(docs: DataFrame) -> DataFrame:
    """Lower-cased texts (doc_id, text, held) in blocks; a long text may go on in the next block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, seen = exchange.new_block(), 0
        start = take()  # rows are numbered like blocks
        for table in gathered(batches, "text", exchange.BLOCK_BYTES):
            ids, held = table["doc_id"].to_pylist(), table["held"].to_pylist()
            for part in parts(table["text"].combine_chunks(), IS_SPACE, exchange.BLOCK_BYTES):
                texts = part.text.tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([take()]), *[pa.array([x.tobytes()], pa.binary()) for x in (
                        LOWER[part.data], part.offsets.astype(np.int64), LOWER[part.prior])],
                    pa.array([len(part.rest) == 0]), pa.array([[start + seen + t for t in texts]], pa.list_(pa.int64())),
                    pa.array([[ids[t] for t in texts]], pa.list_(pa.int64())),
                    pa.array([[held[t] for t in texts]], pa.list_(pa.bool_())),
                ], names=["block", "data", "offsets", "prior", "ended", "uid", "doc_id", "held"])
            seen += len(ids)

    return docs.mapInArrow(build, TEXTS)


@dataclass
class Texts:
    """A block: its bytes, where its parts begin, which of them end a text, and whether they train."""

    data: np.ndarray
    offsets: np.ndarray
    prior: np.ndarray
    final: np.ndarray
    trains: np.ndarray

    @staticmethod
    def of(block: dict) -> Texts:
        offsets = values(block["offsets"], np.int64)
        final = np.ones(len(offsets) - 1, bool)
        final[-1:] = block["ended"].as_py()
        return Texts(values(block["data"], np.uint8), offsets, values(block["prior"], np.uint8), final,
                     ~np.array(block["held"].as_py(), bool))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The run of every byte and end of text as a key, and its part."""
        sizes = np.diff(self.offsets)
        shift = np.arange(len(sizes)) * DEPTH + np.concatenate([[0], np.cumsum(self.final[:-1])]).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        stream = np.full(len(self.data) + len(sizes) * DEPTH + int(self.final.sum()), EDGE, np.uint8)
        stream[np.arange(len(self.data)) + shift[owner] + DEPTH] = self.data
        before = self.prior[-DEPTH:]
        if len(before):
            stream[DEPTH - len(before):DEPTH] = before
        own = np.ones(len(stream), bool)
        own[(self.offsets[:-1] + shift)[:, None] + np.arange(DEPTH)] = False
        at = np.flatnonzero(own)
        part = np.repeat(np.arange(len(sizes)), sizes + self.final)
        key = (stream[at - 1].astype(np.uint64) << np.uint64(8) | stream[at - 2]) * np.uint64(_SPREAD) & np.uint64(0xFFFF)
        for i in range(3, DEPTH + 1):
            key = key << np.uint64(8) | stream[at - i]
        return (key << np.uint64(8) | stream[at]) << np.uint64(_NEXT_AT), part

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and part of every word."""
        starts, ends, part = split_words(self.data, self.offsets)
        return span_hashes(self.data, starts, ends, False), part


def _ask_grams(block: dict) -> tuple[np.ndarray, np.ndarray]:
    texts = Texts.of(block)
    key, part = texts.grams()
    # The low bit, free in every key, carries whether the byte trains.
    key = np.sort(key | texts.trains[part])
    plain = key & ~np.uint64(1)
    new = np.flatnonzero(np.append(True, plain[1:] != plain[:-1])) if len(key) else np.zeros(0, np.int64)
    return plain[new], np.add.reduceat((key & np.uint64(1)).astype(np.int64), new) if len(new) else new


def _ask_words(block: dict) -> tuple[np.ndarray, np.ndarray]:
    texts = Texts.of(block)
    key, part = texts.words()
    keys, number = np.unique(key, return_inverse=True)
    return keys, np.bincount(number[texts.trains[part]], minlength=len(keys))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series above 8."""
    low = np.zeros_like(x)
    small = x < 8
    shifted = np.where(small, x + 8, x)
    s = x[small]
    for i in range(8):
        low[small] += np.log(s + i)
    i2 = 1 / (shifted * shifted)
    series = (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680))) / shifted
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * np.log(2 * np.pi) + series - low


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with these counts by the Krichevsky-Trofimov estimate."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1)


@dataclass
class Level:
    """Nodes of one context length: sorted ids, counts, weight of stopping here, log weighted probability."""

    node: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    stop: np.ndarray
    weighted: np.ndarray


def _level(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray | None) -> Level:
    """Nodes added up by id; ``longer`` has the log weighted probabilities of their longer contexts."""
    ids, number = np.unique(node, return_inverse=True)
    add = lambda x: np.bincount(number, x, len(ids)).astype(float)
    zeros, ones = add(zeros), add(ones)
    own = estimate(zeros, ones)
    if longer is None:
        return Level(ids, zeros, ones, np.ones(len(ids)), own)
    below = add(longer)
    return Level(ids, zeros, ones, 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.logaddexp(own, below) - np.log(2))


def _choices(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node (1 to 255) and bit of each of the eight choices of a byte, by choice."""
    i = np.arange(8, dtype=np.uint64)[:, None]
    node = np.uint64(1) << i | following >> (np.uint64(8) - i)
    return node, (following >> (np.uint64(7) - i) & np.uint64(1)).astype(bool)


def _context(key: np.ndarray, depth: int) -> np.ndarray:
    return key >> np.uint64(64 - 8 * depth)


def _following(key: np.ndarray) -> np.ndarray:
    return key >> np.uint64(_NEXT_AT) & np.uint64(255)


def subtrees(keys: np.ndarray, counts: np.ndarray) -> dict[int, Level]:
    """Levels ``DEPTH`` down to 2 of a bucket's runs."""
    seen = counts > 0
    key, n = keys[seen], counts[seen].astype(float)
    node, bit = _choices(_following(key))
    ids = (_context(key, DEPTH) << np.uint64(8) | node).ravel()
    each = np.tile(n, 8)
    levels = {DEPTH: _level(ids, each * ~bit.ravel(), each * bit.ravel(), None)}
    for depth in range(DEPTH - 1, 1, -1):
        x = levels[depth + 1]
        up = x.node >> np.uint64(16) << np.uint64(8) | x.node & np.uint64(255)
        levels[depth] = _level(up, x.zeros, x.ones, x.weighted)
    return levels


def _last_byte(pair: np.ndarray) -> np.ndarray:
    return (pair * np.uint64(_UNSPREAD) & np.uint64(0xFFFF)) >> np.uint64(8)


def _crowns(bucket: int, blocks: np.ndarray, keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[dict]:
    """What a bucket adds to the nodes of contexts of one byte."""
    every, total, _, _ = exchange.merged(keys, counts)
    pairs = subtrees(every, total)[2]
    node = _last_byte(pairs.node >> np.uint64(8)) << np.uint64(8) | pairs.node & np.uint64(255)
    ids, number = np.unique(node, return_inverse=True)
    fixed = np.zeros(len(ids), np.int64)
    np.add.at(fixed, number, np.rint(pairs.weighted * FIXED).astype(np.int64))
    add = lambda x: np.bincount(number, x, len(ids)).astype(np.int64)
    yield {"node": ids.astype(np.int32), "zeros": add(pairs.zeros), "ones": add(pairs.ones), "weighted": fixed}


@dataclass
class Top:
    """The levels of one byte and of no context, by node (and last byte): mixture = offset + factor * what is below."""

    zeros: np.ndarray
    ones: np.ndarray
    stop: np.ndarray

    @staticmethod
    def of(rows: list) -> Top:
        """Two rows of 65,536 entries: the contexts of one byte, and the empty one (its first 256)."""
        table = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4)
        one = _level(table[:, 0].astype(np.uint64), table[:, 1], table[:, 2], table[:, 3] / FIXED)
        none = _level(one.node & np.uint64(255), one.zeros, one.ones, one.weighted)
        top = Top(*[np.zeros((2, 1 << 16)) for _ in range(3)])
        for row, level in enumerate((one, none)):
            at = level.node.astype(np.int64)
            top.zeros[row, at], top.ones[row, at], top.stop[row, at] = level.zeros, level.ones, level.stop
        return top


def _mixed(p: np.ndarray, seen: np.ndarray, zeros: np.ndarray, ones: np.ndarray, stop: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """One level up: where the context was seen, its estimate against ``p``, that of the longer ones (nan: none was seen)."""
    own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
    mixed = np.where(np.isnan(p), own, stop * own + (1 - stop) * p)
    return np.where(seen, mixed, p)


def code_lengths(keys: np.ndarray, levels: dict[int, Level], top: Top) -> np.ndarray:
    """Log2 probability of the byte of every run after its context.

    Contexts never seen in training say nothing: the mixture begins at the longest seen one.
    """
    node, bit = _choices(_following(keys))
    p = np.full(node.shape, np.nan)
    for depth in range(DEPTH, 1, -1):
        level = levels[depth]
        if len(level.node):
            ids = _context(keys, depth) << np.uint64(8) | node
            at = np.minimum(np.searchsorted(level.node, ids), len(level.node) - 1)
            p = _mixed(p, level.node[at] == ids, level.zeros[at], level.ones[at], level.stop[at], bit)
    last = _last_byte(_context(keys, 2)) << np.uint64(8)
    for row, ids in ((0, last | node), (1, node)):
        at = ids.astype(np.int64)
        zeros, ones = top.zeros[row, at], top.ones[row, at]
        p = _mixed(p, zeros + ones > 0, zeros, ones, top.stop[row, at], bit)
    return np.log2(np.where(np.isnan(p), 0.5, p)).sum(axis=0)


def _spread(found: np.ndarray, order: np.ndarray, number: np.ndarray, keys: list[np.ndarray]) -> list[np.ndarray]:
    """A value of every distinct key, back at each block's keys."""
    out = np.empty(len(order), found.dtype)
    out[order] = found[number]
    stops = np.cumsum([len(k) for k in keys])
    return [out[e - len(k):e] for e, k in zip(stops, keys)]


def _lengths(top: Top):
    def answer(bucket: int, blocks: np.ndarray, keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[dict]:
        every, total, order, number = exchange.merged(keys, counts)
        bits = code_lengths(every, subtrees(every, total), top).astype(np.float32)
        yield {"block": blocks, "bucket": [bucket] * len(blocks), "kind": [0] * len(blocks),
               "answer": [x.tobytes() for x in _spread(bits, order, number, keys)]}

    return answer


def _word_counts(bucket: int, blocks: np.ndarray, keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[dict]:
    _, total, order, number = exchange.merged(keys, counts)
    known = np.zeros(len(blocks), np.int64)
    known[0] = (total > 0).sum()
    yield {"block": blocks, "bucket": [bucket] * len(blocks), "kind": [1] * len(blocks),
           "answer": [exchange.packed(x) for x in _spread(total, order, number, keys)], "known": known}


def _scored(training: int, distinct: int, ends: int):
    """Adds up the answers of a block by part; ``training`` tokens, ``distinct`` ones, and how often a text ends."""
    base = lambda c: np.log10((c + 1) / (training + distinct + 1))

    def score(block: dict, answers: pa.Table) -> dict:
        texts = Texts.of(block)
        kinds = answers["kind"].to_numpy()
        got = lambda kind, dtype, read: np.concatenate(
            [np.zeros(0, dtype), *[read(answers["answer"][i]) for i in np.flatnonzero(kinds == kind)]])
        count = len(texts.final)
        key, part = texts.grams()
        bits = got(0, np.float32, lambda x: values(x, np.float32)).astype(float)[np.unique(key, return_inverse=True)[1]]
        score = np.bincount(part, bits, count) * np.log10(2)
        key, part = texts.words()
        c = got(1, np.int64, lambda x: exchange.unpacked(x).view(np.int64))[np.unique(key, return_inverse=True)[1]]
        base_score = np.bincount(part, base(c.astype(float)), count) + texts.final * base(float(ends))
        n = np.bincount(part, minlength=count) + texts.final
        known = np.bincount(part[c > 0], minlength=count) + (texts.final & (ends > 0))
        column = lambda x, kind: pa.array(x, kind)
        return {
            "uid": column(block["uid"].as_py(), pa.int64()), "doc_id": column(block["doc_id"].as_py(), pa.int64()),
            "held_out": column(block["held"].as_py(), pa.bool_()), "n_tokens": column(n, pa.int64()),
            "n_known": column(known, pa.int64()), "n_bytes": column(np.diff(texts.offsets), pa.int64()),
            "base_score": column(base_score, pa.float64()), "score": column(score, pa.float64())}

    return score


def held_out(doc_id: Column) -> Column:
    """True where CRC32 of the id as text leaves 2 when divided by 7; these rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def text_scores(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """Scores of every row of ``docs`` by a model of the rows that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10
    probability by add-one word counts), score (log10 probability of the lower-cased
    text and its end by the weighted context trees), n_bytes, bits_per_byte (code length
    per byte, the end shared out). Null and empty texts are one end. A null id is not
    held out. Repeated rows train and come back each. Without training rows every byte
    costs eight bits. An empty table gives no rows. Extra columns are not read.
    """
    prepared(docs.sparkSession)
    doc_id = docs["doc_id"].cast("long")
    thin = docs.select(doc_id.alias("doc_id"), "text", (held_out(doc_id) if held is None else held).alias("held"))
    state = exchange.written(text_blocks(thin), "texts")
    grams = exchange.kept(exchange.asked(state.rows, _ask_grams, state.buckets, 16), "grams").rows
    crowns = exchange.answered(grams, _crowns, "node INT, zeros BIGINT, ones BIGINT, weighted BIGINT")
    top = Top.of(crowns.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).collect())
    lengths = exchange.answered(grams, _lengths(top), ANSWERS)
    questions = exchange.asked(state.rows, _ask_words, state.buckets)
    counts = materialize(exchange.answered(questions, _word_counts, ANSWERS + ", known BIGINT"), "word-counts")
    words = counts.agg(F.sum("known")).first()[0] or 0
    ends = thin.agg(F.count_if(~F.col("held"))).first()[0]
    trained = state.rows.mapInArrow(_training_words, "n BIGINT").agg(F.sum("n")).first()[0] or 0
    training, distinct = trained + ends, words + (ends > 0)
    answers = lengths.unionByName(counts.drop("known"))
    found = exchange.met(state.rows, answers, _scored(training, distinct, ends), PARTS)
    whole = found.groupBy("uid", "doc_id", "held_out").agg(
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "base_score", "score")])
    bits = -F.col("score") / F.lit(float(np.log10(2))) / F.greatest("n_bytes", F.lit(1))
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(training).cast("long").alias("train_tokens"), "base_score",
        "score", "n_bytes", bits.alias("bits_per_byte"))


def _training_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            texts = Texts.of({n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)})
            _, _, part = split_words(texts.data, texts.offsets)
            yield pa.RecordBatch.from_arrays([pa.array([int(texts.trains[part].sum())])], names=["n"])
