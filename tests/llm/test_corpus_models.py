"""Collocations, importance resampling and context-tree scores against plain versions and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heliospan.llm import collocations, context_tree, exchange, resampling, words
from heliospan.llm.common import numbered, prepared

DOCS = "doc_id BIGINT, text STRING, lang STRING, rank STRING, score INT, n INT"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))


def awkward():
    rng = random.Random(21)
    vocabulary = ["the", "Sun", "sets", "ñandú", "x1", "roof", "of", "漢字", "a" * 40]
    texts = [None, "", " \t\n ", ".,;", "the sun", "the\tsun sets. the sun\nsets", "x" * 3000, "the sun " * 400]
    texts += [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", "\r\n"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "de", None, "und"]), "clash", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[20], rows[20], (None, "the sun sets of the roof", "en", None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    prepared(spark)
    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return prepared(spark).createDataFrame([], DOCS)


class Captured:
    """Stands for a DataFrame whose map function is run in this process."""

    def select(self, *columns):
        return self

    def mapInArrow(self, work, schema):
        return work


def blocks_of(monkeypatch, build, table, limit):
    count = iter(range(1, 1 << 30))
    monkeypatch.setattr(exchange, "BLOCK_BYTES", limit)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", limit)
    monkeypatch.setattr(exchange, "new_block", lambda: lambda: next(count))
    for batch in build(Captured())(iter(table.to_batches(7))):
        yield {n: batch.column(i)[0] for i, n in enumerate(batch.schema.names)}


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text))]


def plain_phrases(rows):
    f, n = defaultdict(Counter), Counter()
    for row in rows:
        for piece in pieces(row[1]):
            n[row[2] or "und"] += len(piece)
            for k in range(1, 5):
                f[row[2] or "und"].update(tuple(piece[i:i + k]) for i in range(len(piece) - k + 1))
    return f, n


def plain_collocations(rows, top, least):
    f, n = plain_phrases(rows)
    out = []
    for lang, counts in f.items():
        found = {}
        for g, a in counts.items():
            if len(g) > 1 and a >= least:
                cuts = [(2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                found[g] = (score, a, counts[g[:k]], counts[g[k:]])
        covered = set()
        for g, (_, a, _, _) in found.items():
            for z in range(2, len(g)):
                for s in range(len(g) - z + 1):
                    if 100 * a >= 80 * counts[g[s:s + z]]:
                        covered.add(g[s:s + z])
        kept = sorted(((-s, -a, " ".join(g).encode()), l, r) for g, (s, a, l, r) in found.items() if g not in covered)
        for i, ((s, a, phrase), l, r) in enumerate(kept[:top], 1):
            out.append((lang, i, phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("top,least", [(2000, 3), (5, 2), (10, 10**6)])
def test_collocations_match_a_plain_version(docs, none, top, least):
    got = sorted(tuple(r) for r in collocations.collocations(docs, top, least).collect())
    assert got == plain_collocations(awkward(), top, least)
    if least == 3:
        assert len(got) > 50 and collocations.collocations(none).count() == 0


def test_phrases_over_cuts_of_long_texts_count_once(monkeypatch):
    rows = awkward()
    table = pa.table({"text": [r[1] for r in rows], "lang": [r[2] for r in rows]})
    f, _ = plain_phrases(rows)
    total, spelled = {k: Counter() for k in (2, 3, 4)}, {}
    seen = 0
    for block in blocks_of(monkeypatch, collocations.word_blocks, table, 300):
        seen += 1
        block = dict(block)
        read = lambda name, kind: collocations._get(block[name], kind)  # noqa: B023, E731
        ids, lang = read("ids", np.int32), read("lang", np.int32)
        text, ends = read("spelled", np.uint8).tobytes(), read("ends", np.int64).tolist()
        word = lambda i: (block["langs"].as_py()[lang[i]], text[ends[i - 1] if i else 0:ends[i]].decode())  # noqa: B023, E731
        for k in (2, 3, 4):
            at, key = collocations._extended(block, k)
            for p, g in zip(at.tolist(), key.tolist()):
                spelled[k, g] = tuple(word(i) for i in ids[p:p + k])
            keys, counts = collocations._ask(k)(block)
            total[k].update(dict(zip(keys.tolist(), counts.tolist())))
            # All phrases are taken as frequent here, so the next length sees every position.
            every = np.full(len(ids), -1, np.int32)
            every[at] = 0
            block[f"g{k}"] = collocations._put(every)
    assert seen > 20
    want = {(k, tuple((lang, w) for w in g)): n for lang, c in f.items() for g, n in c.items() if (k := len(g)) > 1}
    assert {(k, spelled[k, g]): n for k in total for g, n in total[k].items() if n} == want


def test_scores_of_huge_counts_are_exact():
    a, left, right = 10**13 + 1, 10**14 + 7, 10**13 + 1
    cells = {"ids": np.array([0, 1], np.int32), "n1": np.array([left, right]), "spelled": np.frombuffer(b"ab", np.uint8),
             "ends": np.array([1, 2]), "lang": np.zeros(2, np.int32)}
    block = {name: collocations._put(x) for name, x in cells.items()} | {"langs": pa.scalar(["en"])}
    found = collocations._described(block, 2, np.array([0]), np.array([a]))[0].as_py()
    assert found == [{"lang": "en", "phrase": "a b", "a": a, "l": left, "r": right, "score": 2_000_000 * a // (left + right)}]


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]


def plain_resample(rows, target, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(bucket, plain_features(r[1])[1]))
    for x in target:
        t.update(map(bucket, plain_features(x)[1]))
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for r in rows:
        w, f = plain_features(r[1])
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r[0], len(f), weight, score, None, len(w) >= least])
    ranked = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(ranked[:25 * len(ranked) // 100], 1):
        x[4] = i
    return sorted((tuple(x[:5]) for x in out), key=repr)


def test_resampling_matches_a_plain_version(spark, docs, none):
    target = ["The sun, the ROOF of x1", None, "漢字 ñandú"]
    bench = spark.createDataFrame([(t,) for t in target], "text STRING")
    for least in (20, 1, 10_000):
        got = resampling.resample(docs, bench, min_words=least)
        rows = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
        assert rows == plain_resample(awkward(), target, least)
        drawn = resampling.drawn_documents(docs, bench, min_words=least)
        assert drawn.columns == ["doc_id", "text", "lang", "rank", "n", "n_features", "weight", "score"]
        assert drawn.count() >= sum(r[4] is not None for r in rows)
    assert resampling.resample(none, bench).count() == 0 and resampling.drawn_documents(none, bench).count() == 0
    assert resampling.resample(docs, bench.limit(0)).count() == len(awkward())


@pytest.mark.parametrize("bracket", [1e-9, 0.005, 2.0])
def test_cutoff_is_exact_whatever_the_first_bracket(spark, bracket):
    rng = random.Random(5)
    rows = [(i if i % 50 else None, rng.choice([7, 7, 7, rng.randint(0, 1000)])) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id BIGINT, score BIGINT")
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for k in (1, 10, 750, 1500, 3000):
        cut = resampling.cutoff(table, k, len(rows), bracket)
        assert (cut["doc_id"], cut["score"]) == order[k - 1]
    places = numbered(table, [F.desc("score"), F.asc_nulls_last("doc_id")], "place").collect()
    assert [(r.doc_id, r.score) for r in sorted(places, key=lambda r: r.place)] == order


def test_features_do_not_depend_on_cuts():
    column = pa.array([r[1] for r in awkward()], pa.string())
    count = lambda limit: [Counter(zip(*(x.tolist() for x in (np.concatenate(c) for c in list(zip(*resampling.feature_buckets(column, limit=limit)))[:2])))) ][0]
    assert count(1 << 21) == count(64) and len(list(words.parts(column, resampling.BREAKS, 64))) > 50
    for i in range(200):
        rng = random.Random(i)
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randrange(300))) for _ in "ab")
        got = resampling.crc_joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert got[0] == zlib.crc32(a + b)


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def choices(text):
    """Context (last byte first), node and bit of every choice of a text and its end."""
    depth = context_tree.DEPTH
    s = b"\xff" * depth + lower(text).encode() + b"\xff"
    for j in range(depth, len(s)):
        for i in range(8):
            yield s[j - depth:j][::-1], 1 << i | s[j] >> 8 - i, s[j] >> 7 - i & 1


def plain_scores(rows):
    depth, counts = context_tree.DEPTH, defaultdict(lambda: [0, 0])
    for r in rows:
        if not held(r[0]):
            for context, node, bit in choices(r[1]):
                for d in range(depth + 1):
                    counts[context[:d], node][bit] += 1
    below, stop = defaultdict(float), {}
    for (context, node), (a, b) in sorted(counts.items(), key=lambda x: -len(x[0][0])):
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        if len(context) == depth:
            weighted, stop[context, node] = own, 1.0
        else:
            s = below[context, node]
            weighted = max(own, s) + math.log1p(math.exp(-abs(own - s))) - math.log(2)
            stop[context, node] = 1 / (1 + math.exp(min(s - own, 700)))
        if context:
            below[context[:-1], node] += weighted
    tokens = Counter()
    for r in rows:
        if not held(r[0]):
            tokens.update([*re.findall(r"[^\x20\x09-\x0D]+", lower(r[1])), None])
    total, distinct = tokens.total(), len(tokens)
    for r in rows:
        log = 0.0
        for context, node, bit in choices(r[1]):
            p = None
            for d in range(depth, -1, -1):
                if (context[:d], node) in counts:
                    n = counts[context[:d], node]
                    own = (n[bit] + 0.5) / (sum(n) + 1)
                    w = stop[context[:d], node]
                    p = own if p is None else w * own + (1 - w) * p
            log += math.log10(0.5 if p is None else p)
        own = [*re.findall(r"[^\x20\x09-\x0D]+", lower(r[1])), None]
        base = sum(math.log10((tokens[x] + 1) / (total + distinct + 1)) for x in own)
        yield r[0], held(r[0]), len(own), sum(tokens[x] > 0 for x in own), total, base, log


def test_context_tree_scores_match_a_plain_version(docs, none):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = sorted((tuple(r) for r in context_tree.text_scores(docs).select(*names).collect()), key=repr)
    want = sorted(plain_scores(awkward()), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want] and any(r[1] for r in want)
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-4)
    assert context_tree.text_scores(none).count() == 0
    untrained = context_tree.text_scores(docs, F.lit(True)).filter("n_bytes > 0").collect()
    assert all(r.score == pytest.approx(-8 * (r.n_bytes + 1) * math.log10(2), rel=1e-5) and r.train_tokens == 0 for r in untrained)


def test_probabilities_of_all_bytes_add_up_to_one():
    rng = np.random.default_rng(3)
    texts = context_tree.Texts(rng.integers(97, 101, 4000).astype(np.uint8), np.array([0, 1000, 4000]), np.zeros(0, np.uint8), np.ones(2, bool), np.ones(2, bool))
    keys, counts = np.unique(texts.grams()[0], return_counts=True)
    levels = context_tree.subtrees(keys, counts)
    rows = []
    for x in context_tree._crowns(0, np.array([1]), [keys], [counts]):
        rows += list(zip(x["node"].tolist(), x["zeros"].tolist(), x["ones"].tolist(), x["weighted"].tolist()))
    top = context_tree.Top.of(rows)
    at = np.uint64(context_tree._NEXT_AT)
    for key in (keys[0], keys[len(keys) // 2], np.uint64(0x1234567890ABCDEF) >> at << at):
        context = key >> (at + np.uint64(8)) << (at + np.uint64(8))
        every = context | np.arange(256, dtype=np.uint64) << at
        assert np.exp2(context_tree.code_lengths(every, levels, top)).sum() == pytest.approx(1)


def test_runs_do_not_depend_on_cuts(monkeypatch):
    rows = awkward()
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "held": [held(r[0]) for r in rows]})

    def count(limit):
        total, n = Counter(), 0
        for block in blocks_of(monkeypatch, context_tree.text_blocks, table, limit):
            keys, counts = context_tree._ask_grams(block)
            total.update(dict(zip(keys.tolist(), counts.tolist())))
            n += 1
        return total, n

    whole, cut = count(1 << 22), count(200)
    assert whole[0] == cut[0] and cut[1] > 20 > whole[1]


def test_estimates_of_the_tree():
    n = np.array([0, 1, 2, 7, 8, 1000, 10**9], float)
    got = context_tree.estimate(n, n[::-1])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for a, b in zip(n, n[::-1])]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-5)  # the terms of 10^9 cancel


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(4)
    for x in (np.zeros(0, np.uint64), np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)), np.array([5], np.uint64)):
        assert (exchange.unpacked(exchange.packed(x, True), True) == x).all() and (exchange.unpacked(exchange.packed(x)) == x).all()
