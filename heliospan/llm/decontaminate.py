"""Benchmark decontamination: CGK embedding, bit-sampling LSH over pieces of items, exact edit check.

The embedding walks through words with a random step per place and symbol, so that
a few edits turn into a few differing places: edit distance becomes Hamming
distance, and keys of a few sampled places collide for close windows. A long walk
drifts over most places, so items are cut into pieces of ``PIECE_WORDS`` to twice as
many words. Of an item within its edit limit one piece at least is within its share
of the edits, and that share is at most one word in five again. Symbols are
lower-cased words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.llm.common import list_array, materialize, over_batches, prepared
from heliospan.llm.words import Block, blocks, mix, runs

# A window leaks an item when at most one edit per five words of the item parts them.
WORDS_PER_EDIT = 5
SEED_WORDS = 3
# An item of n words is cut into max(1, n // PIECE_WORDS) pieces.
PIECE_WORDS = 10
# Walks, tables of each and places sampled for a table. With these a piece at its full
# share of edits collides in some table with a chance of 0.97 or more (see the tests).
WALKS, TABLES, SAMPLED, STRETCH = 6, 12, 3, 3
# Windows embedded, and words compared, at a time.
CHUNK = 1 << 14
PIECE = 1 << 20
# Items looked up in one pass; a larger benchmark takes several passes over the documents.
ITEMS_PER_PASS = 20_000
SEED = np.uint64(10)

ITEMS = "item_id BIGINT, n INT, words ARRAY<BIGINT>"
HITS = "doc_id BIGINT, item_id BIGINT, start INT, n INT, edits INT"


_draws = np.random.default_rng(10).random((WALKS, TABLES, SAMPLED))


@dataclass
class Seeds:
    """Word runs of ``size`` of the pieces, sorted: where each stands in its piece, and the piece's size and share of edits."""

    size: int
    hashes: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    share: np.ndarray


@dataclass
class Items:
    """Benchmark items, their pieces, and the sorted keys of all pieces."""

    ids: np.ndarray
    bounds: np.ndarray  # words of item i are ``words[bounds[i]:bounds[i + 1]]``
    words: np.ndarray
    item: np.ndarray  # of each piece
    offset: np.ndarray  # of each piece in its item
    length: np.ndarray
    share: np.ndarray
    keys: np.ndarray
    piece: np.ndarray  # of each key
    seeds: list[Seeds]


def cgk(words: np.ndarray, walk: int) -> np.ndarray:
    """Embedding of windows of one length, (STRETCH * length, windows); past its end a window has zeros."""
    count, length = words.shape
    at = np.arange(count) * (length + 1)
    stop = at + length
    flat = np.concatenate([words, np.zeros((count, 1), np.uint64)], axis=1).reshape(-1)
    out = np.empty((STRETCH * length, count), np.uint64)
    for j in range(STRETCH * length):
        symbol = flat[at]
        out[j] = symbol
        # The random bit of this place and symbol: the top bit of a multiplication by the place's odd number.
        odd = mix(np.array([j * 64 + walk], np.uint64) + SEED) | np.uint64(1)
        at = np.minimum(at + ((symbol * odd) >> np.uint64(63)).astype(np.int64), stop)
    return out


def lsh_keys(words: np.ndarray) -> np.ndarray:
    """Keys of windows of one length: every table hashes a few sampled places of a walk, and the length."""
    count, length = words.shape
    keys = np.empty((count, WALKS * TABLES), np.uint64)
    for walk in range(WALKS):
        embedded = cgk(words, walk)
        for t in range(TABLES):
            total = np.full(count, (length << 16) + (walk << 8) + t, np.uint64)
            # A walk takes two steps for a word on average; later places are mostly past the end.
            for u in _draws[walk, t]:
                total = mix(total * np.uint64(31) ^ embedded[int(u * 2 * length)])
            keys[:, walk * TABLES + t] = mix(total)
    return keys


def seed_words(length: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Words of the seeds of a piece, few enough that one at least is untouched by its share of the edits."""
    return np.minimum(SEED_WORDS, -(-(length - share) // (share + 1)))


def _items(batch: pa.RecordBatch) -> Iterator[dict]:
    for block in blocks(batch.column("text")):
        n = np.diff(block.bounds)
        rows = np.flatnonzero(n > 0)
        if len(rows):
            words = list_array(block.hashes.view(np.int64), block.bounds)
            yield {
                "item_id": batch.column("item_id").slice(block.first, block.count).take(pa.array(rows)),
                "n": n[rows], "words": words.take(pa.array(rows)),
            }


def lookup(ids: list[int], words: list[np.ndarray]) -> Items:
    bounds = np.cumsum([0, *map(len, words)]).astype(np.int64)
    flat = np.concatenate([*words, np.zeros(0, np.uint64)])
    n = np.diff(bounds)
    pieces = np.maximum(n // PIECE_WORDS, 1)
    item = np.repeat(np.arange(len(n)), pieces)
    turn = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    offset = turn * n[item] // pieces[item]
    length = (turn + 1) * n[item] // pieces[item] - offset
    share = n[item] // WORDS_PER_EDIT // pieces[item]
    keys, owner, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], {}
    wanted = seed_words(length, share)
    for size in np.unique(length).tolist():
        own = np.flatnonzero(length == size)
        here = flat[(bounds[item[own]] + offset[own])[:, None] + np.arange(size)]
        keys.append(lsh_keys(here).ravel())
        owner.append(np.repeat(own, WALKS * TABLES))
        for k in np.unique(wanted[own]).tolist():
            some = wanted[own] == k
            hashes = np.stack([runs(x, k) for x in here[some]])
            count = size - k + 1
            rows.setdefault(k, []).append(np.stack([
                hashes.ravel(), np.tile(np.arange(count, dtype=np.uint64), some.sum()), np.full(hashes.size, size, np.uint64),
                np.repeat(share[own[some]], count).astype(np.uint64)], axis=1))
    seeds = []
    for k, found in rows.items():
        table = np.unique(np.concatenate(found), axis=0)
        seeds.append(Seeds(k, table[:, 0].copy(), *(table[:, i].astype(np.int64) for i in (1, 2, 3))))
    every, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(every, kind="stable")
    return Items(np.array(ids, np.int64), bounds, flat, item, offset, length, share, every[order], owner[order], seeds)


def _expanded(low: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The numbers ``low[i]`` up to ``low[i] + each[i]``, for every i in turn."""
    return np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)


def _windows(block: Block, seeds: Seeds) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, length and start of the piece-sized windows around every seed, in groups of about ``PIECE`` seeds."""
    hashes, bounds = runs(block.hashes, seeds.size), block.bounds
    if not len(hashes) or not len(seeds.hashes):
        return
    low = np.searchsorted(seeds.hashes, hashes)
    found = np.flatnonzero(seeds.hashes[np.minimum(low, len(seeds.hashes) - 1)] == hashes)
    found = found[block.text[found] == block.text[found + seeds.size - 1]]
    low = low[found]
    each = np.searchsorted(seeds.hashes, hashes[found], "right") - low
    total, i = np.append(0, np.cumsum(each)), 0
    while i < len(found):
        j = max(int(np.searchsorted(total, total[i] + PIECE, "right")) - 1, i + 1)
        at, place = _expanded(low[i:j], each[i:j]), np.repeat(found[i:j], each[i:j])
        i = j
        # An insertion before the seed that a deletion after it makes up for moves the window by one.
        moves = 1 + 2 * (seeds.share[at] > 1)
        text, length = np.repeat(block.text[place], moves), np.repeat(seeds.length[at], moves)
        start = np.repeat(place - seeds.offset[at], moves) + _expanded(-(moves // 2), moves) - bounds[text]
        start = np.clip(start, 0, np.maximum(bounds[text + 1] - bounds[text] - length, 0))
        yield tuple(np.unique(np.stack([text, length, start], axis=1), axis=0).T)


def _words_at(block: Block, padded: np.ndarray, text: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Windows of ``n`` words; behind the end of a text a window has no words."""
    index = (block.bounds[text] + start)[:, None] + np.arange(n)
    return padded[np.where(index < block.bounds[text + 1][:, None], index, len(block.hashes))]


def _candidates(block: Block, padded: np.ndarray, items: Items, seeds: Seeds) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, item and start of the item-sized windows around pieces whose keys collide and whose words are close."""
    for texts, lengths, starts in _windows(block, seeds):
        for size in np.unique(lengths).tolist():
            same = np.flatnonzero(lengths == size)
            for rows in (same[i:i + CHUNK] for i in range(0, len(same), CHUNK)):
                text, start = texts[rows], starts[rows]
                words = _words_at(block, padded, text, start, size)
                # Windows of equal words have equal keys and distances.
                _, first, number = np.unique(runs(words.ravel(), size)[::size], return_index=True, return_inverse=True)
                keys = lsh_keys(words[first])
                low = np.searchsorted(items.keys, keys.ravel())
                each = np.searchsorted(items.keys, keys.ravel(), "right") - low
                window = np.repeat(np.repeat(np.arange(len(first)), keys.shape[1]), each)
                pair = np.unique(window * len(items.item) + items.piece[_expanded(low, each)])
                window, piece = pair // len(items.item), pair % len(items.item)
                close = []
                for i in range(0, len(pair), max(PIECE // size, 1)):
                    w, q = window[i:i + max(PIECE // size, 1)], piece[i:i + max(PIECE // size, 1)]
                    own = items.words[(items.bounds[items.item[q]] + items.offset[q])[:, None] + np.arange(size)]
                    # A window that stands beside its piece differs at its ends, too.
                    close.append(edit_distances(words[first[w]], own) <= 2 * items.share[q])
                keep = np.concatenate(close) if close else np.zeros(0, bool)
                window, piece = window[keep], piece[keep]
                order = np.argsort(number, kind="stable")
                low = np.searchsorted(number[order], window)
                each = np.searchsorted(number[order], window, "right") - low
                at, piece = order[_expanded(low, each)], np.repeat(piece, each)
                if not len(at):
                    continue
                item = items.item[piece]
                n = items.bounds[item + 1] - items.bounds[item]
                # Insertions and deletions of an item-sized window make up for each other, so half the limit lies before a piece.
                reach = n // WORDS_PER_EDIT // 2 + items.share[piece]
                moves = 2 * reach + 1
                place = np.repeat(start[at] - items.offset[piece], moves) + _expanded(-reach, moves)
                text, item, n = np.repeat(text[at], moves), np.repeat(item, moves), np.repeat(n, moves)
                place = np.clip(place, 0, np.maximum(block.bounds[text + 1] - block.bounds[text] - n, 0))
                yield tuple(np.unique(np.stack([text, item, place], axis=1), axis=0).T)


def _hits(batch: pa.RecordBatch, items: Items) -> Iterator[dict]:
    """Windows of the items' lengths within the edit limit."""
    sizes = np.diff(items.bounds)
    for block in blocks(batch.column("text")):
        ids = batch.column("doc_id").slice(block.first, block.count)
        padded = np.append(block.hashes, np.zeros(1, np.uint64))
        for seeds in items.seeds:
            for texts, numbers, starts in _candidates(block, padded, items, seeds):
                for n in np.unique(sizes[numbers]).tolist():
                    same = np.flatnonzero(sizes[numbers] == n)
                    step = max(PIECE // n, 1)
                    for rows in (same[i:i + step] for i in range(0, len(same), step)):
                        text, item, start = texts[rows], numbers[rows], starts[rows]
                        edits = edit_distances(
                            _words_at(block, padded, text, start, n), items.words[items.bounds[item][:, None] + np.arange(n)])
                        close = np.flatnonzero(edits <= n // WORDS_PER_EDIT)
                        yield {
                            "doc_id": ids.take(pa.array(text[close])), "item_id": items.ids[item[close]],
                            "start": start[close], "n": np.full(len(close), n), "edits": edits[close],
                        }


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of every pair of rows of two arrays of word numbers of one length."""
    count, n = a.shape
    before = np.tile(np.arange(n + 1), (count, 1))
    for i in range(1, n + 1):
        now = np.empty_like(before)
        now[:, 0] = i
        now[:, 1:] = np.minimum(before[:, :-1] + (b != a[:, i - 1:i]), before[:, 1:] + 1)
        # An insertion carries the value on: a running minimum of value minus place.
        steps = np.arange(n + 1)
        before = np.minimum.accumulate(now - steps, axis=1) + steps
    return before[:, n]


def _one_pass(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    rows = items.select("item_id", "words").collect()
    found = lookup([r[0] for r in rows], [np.array(r[1], np.int64).view(np.uint64) for r in rows])
    shared = spark.sparkContext.broadcast(found)
    return over_batches(docs, _hits, HITS, lambda: shared.value)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Best hit of every document and benchmark item: doc_id, item_id, start, n, edits.

    ``start`` and ``n`` are in words of the document. A hit is a window of the
    item's length within one word edit per five words; items under five words are
    matched as they are. Pieces of the items are embedded by CGK walks and sought by
    bit-sampling among windows of the documents; where their keys collide, the item is
    compared exactly at every start that the edits allow. Windows stand only where a
    word triple of a piece does (a pair or a word for short ones): a piece within its
    share of the edits has one untouched. Hits are exact, and the tests find more than
    0.95 of all at the full limit. Null or empty texts, items without words and null ids
    give no hits. Repeated rows give one hit. The items of
    a pass go to all tasks, at most ``ITEMS_PER_PASS``; a larger benchmark is taken
    in several passes over all documents.
    """
    spark = prepared(docs.sparkSession)
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = materialize(over_batches(named, _items, ITEMS), "items").dropDuplicates(["item_id", "words"])
    passes = max(1, -(-items.count() // ITEMS_PER_PASS))
    found = None
    for i in range(passes):
        part = _one_pass(spark, rows, items.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(passes)) == i))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "n")).alias("best"))
    return best.select("doc_id", "item_id", "best.start", "best.n", "best.edits")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any hit; all columns stay, rows with a null id too."""
    hit = leaks(docs, benchmark).select(F.col("doc_id").alias("_leaked_id")).distinct()
    return docs.join(hit, docs["doc_id"] == hit["_leaked_id"], "left_anti")
