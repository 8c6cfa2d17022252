"""Phrases of words that stand together, by set-oriented mining of sorted occurrence relations.

R1 holds every word occurrence, sorted by piece and position, in blocks that are
written to the shared folder. For each length in turn, the occurrences of frequent
shorter phrases are merged with those at the next position of the same piece, the
new phrases are counted over all blocks, and only occurrences of frequent ones are
kept (semi-join) and extended. Relations of a language share nothing with others:
its name is part of every word's key.

Keys are 64-bit hashes. Positions, counts and scores are exact; two phrases of one
length would be taken for one only if their hashes agreed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospan.llm import exchange
from heliospan.llm.common import gathered, materialize, prepared
from heliospan.llm.exchange import values
from heliospan.llm.words import LOWER, mix, parts, span_hashes, split_words

MIN_COUNT = 30
MAX_WORDS = 4
SCALE = 2_000_000
COVERED = (80, 100)
TOP = 2000
NO_LANG = "und"
# A block carries all relations of its words, so it is smaller than those of other operators.
BLOCK_BYTES = 1 << 21
BLOCK_KEYS = 1 << 18

PIECE_BREAKS = np.zeros(256, bool)
PIECE_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAKS = PIECE_BREAKS.copy()
BREAKS[[0x20, 0x09]] = True
_STEP = np.uint64(0x9FB21C651E98DF25)

FOUND = "found ARRAY<STRUCT<lang: STRING, phrase: STRING, a: BIGINT, l: BIGINT, r: BIGINT, score: BIGINT>>"
FOUND_TYPE = pa.list_(pa.struct([
    ("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())]))
#: ids: local word of every position (-1: not frequent); own: positions that are not only looked ahead at;
#: joined: whether the next position is in the same piece; keys, spelled, ends, lang: of the local words.
WORDS = "block BIGINT, own INT, ids BINARY, joined BINARY, keys BINARY, spelled BINARY, ends BINARY, lang BINARY, langs ARRAY<STRING>"
FIRST = WORDS + ", totals ARRAY<BIGINT>"
ANSWERS = "block BIGINT, bucket INT, asked INT, at BINARY, n BINARY"


def _put(x: np.ndarray) -> bytes:
    """An array as a compressed cell, so that the rows of blocks stay small."""
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _get(cell: object, kind: type) -> np.ndarray:
    raw = cell.as_py() if isinstance(cell, pa.Scalar) else cell
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind)


def _ahead(rest: np.ndarray, words: int) -> np.ndarray:
    """The bytes of ``rest`` that hold its first ``words`` words."""
    size = 4096
    while True:
        head = rest[:size]
        starts, ends, _ = split_words(head, np.array([0, len(head)]), BREAKS)
        if size >= len(rest) or len(starts) > words:
            return head[:ends[words - 1]] if len(starts) >= words else head
        size *= 4


def word_blocks(docs: DataFrame) -> DataFrame:
    """R1: the word occurrences of all texts, sorted by piece and position, a row for each block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = exchange.new_block()
        for table in gathered(batches, "text", BLOCK_BYTES):
            named = table["lang"].combine_chunks().cast(pa.string()).fill_null(NO_LANG).dictionary_encode()
            if isinstance(named, pa.ChunkedArray):
                named = named.combine_chunks()
            lang_of, langs = named.indices.to_numpy().astype(np.int64), named.dictionary.to_pylist()
            salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in langs], np.uint64)
            for part in parts(table["text"].combine_chunks(), BREAKS, BLOCK_BYTES):
                after = _ahead(part.rest, MAX_WORDS - 1)
                data = LOWER[np.concatenate([part.data, after])]
                offsets = part.offsets.copy()
                offsets[-1] += len(after)
                starts, ends, owner = split_words(data, offsets, BREAKS)
                lang = lang_of[part.text[owner]]
                marks = span_hashes(data, starts, ends, False)
                marks = mix(marks ^ mix(salts[lang])) if len(marks) else marks
                keys, where, ids = np.unique(marks, return_index=True, return_inverse=True)
                breaks = np.cumsum(PIECE_BREAKS[data], dtype=np.int32)
                joined = np.zeros(len(starts), bool)
                joined[:-1] = (owner[1:] == owner[:-1]) & (breaks[starts[1:] - 1] == breaks[ends[:-1] - 1])
                own = int(np.searchsorted(starts, len(part.data)))
                spelled, bounds = _spelled(data, starts[where], ends[where])
                totals = np.bincount(lang[:own], minlength=len(langs))
                yield pa.RecordBatch.from_arrays([
                    pa.array([take()]), pa.array([own], pa.int32()), *[pa.array([_put(x)], pa.binary()) for x in (
                        ids.astype(np.int32), joined, keys, spelled, bounds, lang[where].astype(np.int32))],
                    pa.array([langs], pa.list_(pa.string())), pa.array([totals.tolist()], pa.list_(pa.int64())),
                ], names=["block", "own", "ids", "joined", "keys", "spelled", "ends", "lang", "langs", "totals"])

    return docs.select("text", "lang").mapInArrow(build, FIRST)


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some words in a row, and where each ends."""
    sizes = ends - starts
    bounds = np.cumsum(sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(bounds - sizes, sizes) + np.repeat(starts, sizes)
    return data[at], bounds


def _extended(block: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where both phrases of ``k - 1`` words are frequent and adjacent in their piece, and the keys from there."""
    ids = _get(block["ids"], np.int32)
    short = ids if k == 2 else _get(block[f"g{k - 1}"], np.int32)
    follows = (short[:-1] >= 0) & (short[1:] >= 0)
    if k == 2:
        follows &= _get(block["joined"], bool)[:-1]
    at = np.flatnonzero(follows)
    words = _get(block["keys"], np.uint64)
    key = words[ids[at]]
    for i in range(1, k):
        key = mix(key * _STEP + words[ids[at + i]])
    return at, key


def _ask_words(block: dict) -> tuple[np.ndarray, np.ndarray]:
    keys = _get(block["keys"], np.uint64)
    ids = _get(block["ids"], np.int32)[:block["own"].as_py()]
    return keys, np.bincount(ids, minlength=len(keys))


def _ask(k: int):
    def ask(block: dict) -> tuple[np.ndarray, np.ndarray]:
        at, key = _extended(block, k)
        keys, number = np.unique(key, return_inverse=True)
        return keys, np.bincount(number[at < block["own"].as_py()], minlength=len(keys))

    return ask


def _frequent(least: int):
    def answer(bucket: int, blocks: np.ndarray, keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[dict]:
        """Count of every frequent key of a block; negative at the first block that has the key, which describes it."""
        _, total, order, number = exchange.merged(keys, counts)
        n = np.empty(len(order), np.int64)
        n[order] = np.where(total >= least, total, 0)[number]
        owned = np.concatenate(counts)[order] > 0
        _, first = np.unique(number[owned], return_index=True)
        first = order[owned][first]
        n[first] = -n[first]
        stops = np.cumsum([len(k) for k in keys])
        split = [n[e - len(k):e] for e, k in zip(stops, keys)]
        at = [np.flatnonzero(x).astype(np.int32) for x in split]
        yield {"block": blocks, "bucket": [bucket] * len(blocks), "asked": [len(k) for k in keys],
               "at": [x.tobytes() for x in at], "n": [x[i].tobytes() for x, i in zip(split, at)]}

    return answer


def _gathered_answers(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Index and count of every frequent key among the sorted keys a block asked for."""
    before = np.cumsum([0, *answers["asked"].to_pylist()])
    at = [values(a, np.int32) + b for a, b in zip(answers["at"], before.tolist())]
    n = [values(x, np.int64) for x in answers["n"]]
    return np.concatenate(at) if at else np.zeros(0, np.int64), np.concatenate(n) if n else np.zeros(0, np.int64)


def _keep_words(block: dict, answers: pa.Table) -> dict:
    """The block with its frequent words alone, and their counts."""
    at, n = _gathered_answers(answers)
    keys, lang = _get(block["keys"], np.uint64), _get(block["lang"], np.int32)
    new = np.full(len(keys) + 1, -1, np.int32)
    new[at] = np.arange(len(at), dtype=np.int32)
    ends = _get(block["ends"], np.int64)
    starts = np.append(0, ends[:-1])[:len(ends)]
    spelled, bounds = _spelled(_get(block["spelled"], np.uint8), starts[at], ends[at])
    ids = new[_get(block["ids"], np.int32)]
    return {
        "block": block["block"].as_py(), "own": block["own"].as_py(), "ids": _put(ids), "joined": block["joined"].as_py(),
        "keys": _put(keys[at]), "spelled": _put(spelled), "ends": _put(bounds), "lang": _put(lang[at]),
        "langs": block["langs"].as_py(), "n1": _put(np.abs(n))}


def _described(block: dict, k: int, first: np.ndarray, a: np.ndarray) -> pa.Array:
    """Phrases of ``k`` words that begin at ``first``, with their counts and lowest cut."""
    ids = _get(block["ids"], np.int32)
    n = {1: _get(block["n1"], np.int64)} | {j: _get(block[f"n{j}"], np.int64) for j in range(2, k)}
    g = {1: ids} | {j: _get(block[f"g{j}"], np.int32) for j in range(2, k)}
    cuts = []
    for j in range(1, k):
        left, right = n[j][g[j][first]], n[k - j][g[k - j][first + j]]
        # Python integers: the products may pass 64 bits.
        score = [SCALE * x // (y + z) for x, y, z in zip(a.tolist(), left.tolist(), right.tolist())]
        cuts.append(list(zip(score, [j] * len(score), left.tolist(), right.tolist())))
    spelled, ends = _get(block["spelled"], np.uint8).tobytes(), _get(block["ends"], np.int64).tolist()
    lang, langs = _get(block["lang"], np.int32), block["langs"].as_py()
    word = lambda i: spelled[ends[i - 1] if i else 0:ends[i]].decode()
    rows = []
    for i, p in enumerate(first.tolist()):
        score, _, left, right = min(c[i] for c in cuts)
        rows.append({"lang": langs[lang[ids[p]]], "phrase": " ".join(word(x) for x in ids[p:p + k].tolist()),
                     "a": int(a[i]), "l": left, "r": right, "score": score})
    return pa.array([rows], FOUND_TYPE)


def _keep_phrases(k: int, last: bool):
    def keep(block: dict, answers: pa.Table) -> dict:
        """The block with the occurrences of frequent phrases of ``k`` words, and the phrases it is to describe."""
        at, key = _extended(block, k)
        keys, first, number = np.unique(key, return_index=True, return_inverse=True)
        hit, n = _gathered_answers(answers)
        mine = n < 0
        found = _described(block, k, at[first[hit[mine]]], -n[mine])
        if last:
            return {"block": block["block"].as_py(), "found": found}
        new = np.full(len(keys) + 1, -1, np.int32)
        new[hit] = np.arange(len(hit), dtype=np.int32)
        ids = _get(block["ids"], np.int32)
        phrase = np.full(len(ids), -1, np.int32)
        phrase[at] = new[number]
        # Words outside every frequent phrase take no further part.
        used = np.zeros(len(ids), bool)
        for i in range(k):
            used[i:] |= phrase[:len(ids) - i] >= 0
        out = {c: (x.as_py() if isinstance(x, pa.Scalar) else x) for c, x in block.items()}
        return out | {"ids": _put(np.where(used, ids, -1).astype(np.int32)), f"g{k}": _put(phrase),
                      f"n{k}": _put(np.abs(n)), "found": found}

    return keep


def mined(docs: DataFrame, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Every phrase of 2 to ``MAX_WORDS`` words that occurs ``least`` times in its language, and the words of each language.

    The first has lang, phrase, a (count), l and r (counts of the parts of the lowest
    cut), score; the second lang and n.
    """
    prepared(docs.sparkSession)
    state = exchange.written(word_blocks(docs), "words", BLOCK_KEYS)
    both = state.rows.select(F.explode(F.arrays_zip("langs", "totals")).alias("t"))
    words = both.groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
    words = materialize(words.filter("n > 0"), "words-of-lang")
    schema, found = WORDS + ", n1 BINARY", []
    for k in range(1, MAX_WORDS + 1):
        last = k == MAX_WORDS
        columns = [c.split()[0] for c in schema.split(", ")]
        source = state.rows if k == 1 else state.rows.select(*columns)
        needed = ["block", "own", "ids", "keys", *(["joined"] if k == 2 else [f"g{k - 1}"] if k > 2 else [])]
        questions = exchange.asked(source.select(*needed), _ask_words if k == 1 else _ask(k), state.buckets)
        answers = exchange.answered(questions, _frequent(least), ANSWERS)
        if k > 1:
            schema = "block BIGINT" if last else f"{schema}, g{k} BINARY, n{k} BINARY"
        target = schema if k == 1 else f"{schema}, {FOUND}"
        rows = exchange.met(source, answers, _keep_words if k == 1 else _keep_phrases(k, last), target)
        following = exchange.written(rows, f"phrases{k}", BLOCK_KEYS)
        if k > 1:
            found.append(materialize(following.rows.select(F.explode("found").alias("f")).select("f.*"), f"found{k}"))
        state.drop()
        state = following
    state.drop()
    return found[0].unionByName(found[1]).unionByName(found[2]), words


def _parts_of(phrase: Column) -> Column:
    """All contiguous parts of two words or more that are shorter than the phrase."""
    words = F.split(phrase, " ")
    spans = [(i, n) for n in range(2, MAX_WORDS) for i in range(1, MAX_WORDS - n + 2)]
    each = F.array(*[F.when((F.size(words) > n) & (F.size(words) >= i + n - 1), F.array_join(F.slice(words, i, n), " "))
                     for i, n in spans])
    return F.array_distinct(F.array_compact(each))


def without_covered(found: DataFrame, covered: tuple[int, int] = COVERED) -> DataFrame:
    """Phrases that no longer phrase holds in ``covered`` or more of their occurrences."""
    longer = found.select("lang", F.explode(_parts_of(F.col("phrase"))).alias("phrase"), "a")
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    gone = F.coalesce(exact("_most") * covered[1] >= exact("a") * covered[0], F.lit(False))
    return found.join(most, ["lang", "phrase"], "left").filter(~gone).drop("_most")


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN_COUNT) -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?]`` and line ends into pieces, those
    at spaces and tabs into words. A null lang is ``und``, null and empty texts have no
    words, and repeated rows count each. Ties go to the larger count, then to the phrase
    first in byte order. An empty table, or one without frequent phrases, gives no rows.
    Extra columns are not read. Each task sends at most ``top`` rows of a language on.
    """
    found, words = mined(docs, least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = without_covered(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
