"""Every operator on awkward documents and on an empty table, against brute force or the libraries themselves."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from llm_cases import base_counts, components, frame, lower, shingles, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphline.llm import bpe, common, encode, fertility, filters, jaccard, kneser_ney, lsm_dedup, packing, sharding, token_counts, token_store, warc
from graphline.llm.common import attach

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ROWS = texts()
CODES = [t or "" for _, t, _ in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, []).cache()


def library(path, strings):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return [e.ids for e in tokenizer.encode_batch(strings, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunks_agree_with_whole_texts():
    rng = random.Random(1)
    bits = [*"ab dT's,.!1é\n\n  \t\r▁ñ中́ \x1c\x85", "<|endoftext|>", "<|startoftext|>", "the ", " \n", "'ll", "\U0001f642", "<s>", "İ"]
    strings = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + CODES
    wanted = {"byte": library(BYTE, strings), "word": library(WORD, strings), "piece": sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(strings)}
    for kind, path in (("byte", BYTE), ("word", WORD), ("piece", PIECE)):
        found = encode.encoder(kind, path)
        ids, sizes = found.encode(strings)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == wanted[kind]
        assert found.lengths(strings).tolist() == sizes.tolist()
    small = encode.ChunkEncoder(encode.byte_level_chunks, encode.encoder("byte", BYTE).encode_many, max_chunks=10)
    assert [small.encode([s])[0].tolist() for s in strings[:200]] == wanted["byte"][:200]  # the cache is emptied again and again
    own, sizes = bpe.vocabulary(BYTE).encode(strings)
    assert [x.tolist() for x in np.split(own, np.cumsum(sizes)[:-1])] == wanted["byte"]
    assert bpe.vocabulary(BYTE).decode(own, sizes) == strings


def test_long_runs_are_cut(monkeypatch):
    """Runs without blanks are counted in parts, as the library counts them whole."""
    rng = random.Random(11)
    bits = [*"ab dT's,.!1é\n\n  \t\r▁ñ中́ \x1c\x85", "▁▁", "the ", "中文字符", "Z9", "<s>", "İ", "\U0001f642"]
    strings = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["▁", "▁▁ a", " ▁", "a▁b", "▁\n▁", "x" * 9000]
    strings += ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(9000)), "".join(rng.choice("abcXYZ019+/=") for _ in range(200_000))]
    library_ = sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(strings)
    for long in (2048, 3):
        monkeypatch.setattr(encode, "LONG_CHUNK", long)
        found = encode.MAKERS["cut"](PIECE)
        ids, sizes = found.encode(strings)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library_
        assert max(map(len, found.chunks(strings[-1]))) < long + 200 and len(found.chunks(strings[-2])) > 3


def test_dac_random_access():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.integers(0, 2 ** int(rng.integers(1, 33)), n).astype(np.uint32)
        segment = token_store.DacSegment(token_store.dac_encode(ids))
        for a, b in ((0, n), (n // 3, n // 2), (n // 2, n // 2 + 1), (max(0, n - 1), n), (n, n)):
            assert segment.slice(a, b).tolist() == ids[a:b].tolist()
        assert segment.all().tolist() == ids.tolist() == [segment[i] for i in range(n)]
    with pytest.raises(IndexError):
        segment[3000]
    with pytest.raises(ValueError):
        token_store.DacSegment(b"nope" + bytes(20))


def test_token_store(docs, nothing):
    found = sorted(token_store.round_trip(docs, BYTE).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    wanted = sorted(((i is not None, i or 0), len(x) + 1, crc([*x, 0])) for (i, *_), x in zip(ROWS, library(BYTE, CODES), strict=True))
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_tokens"], r["ids_crc32"]) for r in found) == wanted
    assert [r["start"] for r in found] == (np.cumsum([r["n_tokens"] for r in found]) - [r["n_tokens"] for r in found]).tolist()
    assert token_store.round_trip(nothing, BYTE).count() == 0


def test_token_store_random_access(docs, spark):
    path = common.shared_dir(spark, "t")
    token_store.write(docs, path, BYTE, segment_tokens=3000, batch_chars=5000)
    assert spark.read.parquet(f"{path}/segments").count() > 4
    order = sorted(((i if i is not None else token_store.NULL_ID), [*x, 0]) for (i, *_), x in zip(ROWS, library(BYTE, CODES), strict=True))
    flat = [t for _, x in order for t in x]
    store = token_store.TokenStore.open(spark, path)
    rng = random.Random(8)
    assert [store.token_at(k) for k in range(0, len(flat), 97)] == flat[::97] and store.token_at(len(flat) - 1) == flat[-1]
    for bad in (-1, len(flat)):
        with pytest.raises(IndexError):
            store.token_at(bad)
    for i, x in order:
        if i not in (5, token_store.NULL_ID):
            a, b = sorted(rng.randrange(len(x) + 1) for _ in range(2))
            assert store.tokens(i).tolist() == x and store.tokens(i, a, b).tolist() == x[a:b] and store.tokens(i, a).tolist() == x[a:]
    with pytest.raises(KeyError):
        store.tokens(77777)
    # directories are known now: what a token and a slice of a document cost
    before = store.bytes_read
    store.token_at(len(flat) // 2)
    assert store.bytes_read - before < 250
    before = store.bytes_read
    store.tokens(107, 4000, 4010)
    assert store.bytes_read - before < 1200


def test_token_counts(docs, nothing):
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(CODES)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    wanted = sorted(key((i, len(c.encode()), len(p), len(p) > 4096)) for (i, *_), c, p in zip(ROWS, CODES, pieces, strict=True))
    assert sorted(key(tuple(r)) for r in token_counts.token_counts(docs, PIECE, batch_bytes=5000).collect()) == wanted
    assert token_counts.token_counts(nothing, PIECE).count() == 0


def test_bpe(docs, nothing):
    wanted = sorted((str(i), len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(c.encode()).hexdigest()) for (i, *_), x, c in zip(ROWS, library(BYTE, CODES), CODES, strict=True))
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in bpe.digests(docs, BYTE).collect()) == wanted
    assert bpe.digests(nothing, BYTE).count() == 0


def test_fertility(docs, nothing):
    found = fertility.quality(docs, PIECE, BYTE).collect()
    wanted = sorted((str(i), *(b := base_counts(c)), b[0] < 10 or 100 * b[4] > 20 * b[0]) for (i, *_), c in zip(ROWS, CODES, strict=True))
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == wanted
    assert not any(r["kept"] for r in found if r["base_failed"])
    assert fertility.quality(nothing, PIECE, BYTE).count() == 0
    kept = fertility.keep_good(docs, PIECE, BYTE)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)
    assert [fertility.script_of(t) for t in ("abc", "привет", "中文", "123")] == ["latin", "cyrillic", "han", "latin"]


def test_token_lengths_agree():
    strings = [t for t in CODES if "<|" not in t] + ["", " \n\t x\u3000y  ", "'ll it's", "1234 ab12", "é" * 500]
    assert encode.token_lengths(public_tokenizers.path("byte_bpe_50k.tiktoken"), strings).tolist() == [len(x) for x in library(BYTE, strings)]


def test_fertility_bands_reject(spark):
    rng = random.Random(3)
    prose = lambda n=100: " ".join("".join(rng.choice(["the", "er", "ing", "st", "re", "an"]) for _ in range(2)) for _ in range(n))
    rows = [(k, prose(rng.choice([100, 200, 400])), "en") for k in range(400)] + [(1000, " ".join(w + "$$$###" for w in prose().split()), "en")]
    found = {r["doc_id"]: r["kept"] for r in fertility.quality(frame(spark, rows), PIECE, BYTE).collect()}
    assert not found.pop(1000) and sum(found.values()) >= 396


def test_fertility_bands_of_few_texts(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice(["the", "er", "ing", "st", "re", "an"]) for _ in range(2)) for _ in range(n))
    odd = lambda n: " ".join(w + "$$$###" for w in prose(n).split())
    # no size of a language has 40 texts, and one language has few at any size
    rows = [(k, prose(rng.choice([20, 40, 80, 160, 320, 640])), "en") for k in range(100)] + [(k, prose(rng.choice([40, 80, 160])), "de") for k in range(100, 110)]
    rows += [(1000, odd(100), "en"), (1001, odd(3000), "en"), (1002, odd(15), "en"), (1003, odd(60), "de"), (1004, odd(60), None)]
    for given in (rows, [r for r in rows if r[0] >= 100 and r[2] == "de"]):
        found = {r["doc_id"]: r["kept"] for r in fertility.quality(frame(spark, given), PIECE, BYTE).collect()}
        assert len(found) == len(given)
        assert not any(kept for i, kept in found.items() if i >= 1000)
        assert sum(kept for i, kept in found.items() if i < 1000) >= 0.98 * sum(i < 1000 for i in found)


def test_fertility_is_the_same_in_every_order(spark):
    rng = random.Random(9)
    prose = lambda: " ".join("".join(rng.choice(["the", "er", "ing", "st", "re", "an"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ",", "$#"]) for _ in range(rng.choice([20, 60, 150])))
    shared = [prose() for _ in range(60)]
    rows = [(k, prose(), "en" if k % 3 else "de") for k in range(120)] + [(200 + 2 * k + j, t, lang) for k, t in enumerate(shared) for j, lang in enumerate(("en", "de"))]
    rows += [(900 + j, " ".join(w + "$$##&&" for w in shared[7].split()), lang) for j, lang in enumerate(("en", "de"))]
    found = []
    for order, parts in ((rows, 3), (rng.sample(rows, len(rows)), 8)):
        given = frame(spark, order).repartition(parts)
        found.append(sorted((r["doc_id"], r["kept"]) for r in fertility.quality(given, PIECE, BYTE).collect()))
    assert found[0] == found[1] and 1 < sum(not kept for _, kept in found[0]) < 30


def brute_bands(rows, least=40):
    """kept of each row, from plain lists; rows: (text, lang)."""
    piece, byte = sentencepiece.SentencePieceProcessor(model_file=PIECE), library(BYTE, [t for t, _ in rows])
    measures = []
    for (t, lang), b in zip(rows, byte, strict=True):
        ids, base = piece.encode(t), base_counts(t)
        n, words = max(len(ids), 1), max(base[0], 1)
        share = [k / n for k in Counter(ids).values()]
        m = {"entropy": -sum(x * math.log2(x) for x in share), "tokens_per_word": len(ids) / words, "chars_per_token": len(t) / n, "chars_per_token_b": len(t) / max(len(b), 1), "byte_share": sum(3 <= i < 259 for i in ids) / n}
        measures.append((lang, int(math.log2(n)), base[0] < 10 or 100 * base[4] > 20 * base[0], m))
    good = {t: x for (t, _), x in zip(rows, measures, strict=True) if not x[2]}.values()
    quartile = lambda values, q: sorted(values)[max(0, math.ceil(q * len(values)) - 1)]
    by_size = {}
    for _, size, _, m in good:
        by_size.setdefault(size, []).append(m["entropy"])
    middle = {size: quartile(x, 0.5) for size, x in by_size.items() if len(x) >= max(1, least // 4)}

    def usual(size):
        if not middle:
            return None
        of = min(middle, key=lambda k: (abs(k - size), k))
        return middle[of] - max(of - size, 0)

    def judged(lang, size, failed, m):
        if failed:
            return False
        own = [x for x in good if x[0] == lang]
        own = own if len(own) >= least else good
        away = lambda x: abs(x[1] - size)
        pool = [x for x in own if sum(away(y) < away(x) for y in own) < least]
        for b in fertility.BANDS:
            move = lambda x: usual(size) - usual(x[1]) if b.grows and middle else 0  # noqa: B023, E731
            low, mid, high = (quartile([x[3][b.measure] + move(x) for x in pool], q) for q in (0.25, 0.5, 0.75))
            scale = max((high - low) / 1.349, b.floor, abs(mid) * b.relative)
            if b.below is not None and m[b.measure] < mid - b.below * scale - 1e-12 or b.above is not None and m[b.measure] > mid + b.above * scale + 1e-12:
                return False
        return True

    return [judged(*x) for x in measures], measures


def test_fertility_against_brute_force(spark):
    rng = random.Random(6)
    parts = {"en": ["the", "er", "ing", "st", "re", "an", "x"], "de": ["sch", "en", "ü", "ei", "ge"], "ru": ["по", "на", "ст", "ов"]}
    prose = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", ",", "$", "€"]) for _ in range(n))
    texts_ = [(prose(lang, rng.choice([12, 20, 40, 80, 160, 300])), lang) for lang in ["en"] * 110 + ["de"] * 60 + ["ru"] * 6]
    texts_ += [(" ".join(w + "$$##&&" * rng.randint(0, 2) for w in prose("en", n).split()), lang) for n in (15, 60, 700) for lang in ("en", "ru")]
    texts_ += [("word " * 50, "en"), ("few words", "de"), (prose("de", 2000), "de"), texts_[0], texts_[0]]
    want, measures = brute_bands(texts_)
    found = sorted(fertility.quality(frame(spark, [(k, *x) for k, x in enumerate(texts_)]), PIECE, BYTE).collect(), key=lambda r: r["doc_id"])
    for r, (_, _, _, m) in zip(found, measures, strict=True):
        assert all(r[k] == pytest.approx(v) for k, v in m.items())
    assert [r["kept"] for r in found] == want and 0 < sum(not k for k in want) < 40


def test_sharding(docs, nothing, spark):
    for frame_, shards in ((docs, 24), (docs, 5)):
        found = sharding.shard(frame_, shards, range_bytes=500).collect()
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sorted((str(i), len(c.encode()) + 8, zlib.crc32(c.encode())) for (i, *_), c in zip(ROWS, CODES, strict=True))
        total, largest = sum(r["size"] for r in found), max(r["size"] for r in found)
        for s in range(shards):
            inside = [r for r in found if r["shard"] == s]
            assert sorted(r["slot"] for r in inside) == list(range(len(inside)))
            assert abs(sum(r["size"] for r in inside) - total / shards) <= largest
    assert sharding.shard(nothing).count() == 0
    one = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("some text").alias("text"))
    sizes = [r["n"] for r in sharding.shard(one, 4, range_bytes=2000).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert sizes and max(sizes) - min(sizes) <= 2  # a key that all rows share


def test_sharding_is_the_same_on_every_layout(spark):
    rows = [(7 if k % 5 else k, f"text {k % 90} " + "x" * (k % 37)) for k in range(500)] + [(None, "no id"), (None, None)] + [(3, "the same")] * 200
    random.Random(1).shuffle(rows)
    found = []
    for order, parts in ((rows, 3), (rows[::-1], 7), (sorted(rows, key=str), 1)):
        given = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        found.append(sorted(map(str, sharding.shard(given, 6, range_bytes=300).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


def test_packing(docs, nothing):
    found = packing.pack(docs, WORD, width=512).collect()
    ids = {}
    for (i, *_), x in zip(ROWS, library(WORD, CODES), strict=True):
        ids.setdefault(i, []).append([*x, 2])
    held = {}
    for r in found:
        whole = ids[r["doc_id"]][0]
        assert r["ids_crc32"] == crc(whole[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(whole) and r["length"] <= 512
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in held.values():
        ends = np.cumsum([n for _, n in sorted(rows)])
        assert [o for o, _ in sorted(rows)] == [0, *ends[:-1].tolist()] and ends[-1] <= 512
    total = sum(len(x) for xs in ids.values() for x in xs)
    assert sum(r["length"] for r in found) == total and sorted(held) == list(range(len(held))) and len(held) <= total / 512 * 1.15 + 1
    assert packing.pack(nothing, WORD).count() == 0


def test_histogram_packing():
    rng = random.Random(5)
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, 101), 60)}
    patterns = packing.shortest_pack_first(histogram, 100)
    assert all(sum(n * t for n, t in p) <= 100 for _, p in patterns)
    placed = {}
    for packs, pattern in patterns:
        for n, t in pattern:
            placed[n] = placed.get(n, 0) + packs * t
    assert placed == histogram


def test_exact_dedup(docs, nothing):
    def wanted():
        groups = {}
        for (i, *_), c in zip(ROWS, CODES, strict=True):
            groups.setdefault(lower(c), []).append(i)
        for t, ids in groups.items():
            known = [i for i in ids if i is not None]
            for i in ids:
                yield str(i), max(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()

    told = lambda rows: sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in rows)
    want = list(wanted())
    found = lsm_dedup.dedup(docs, memtable=20, fanout=2).collect()
    assert told(found) == sorted((i, str(k), n) for i, k, n, _ in want)
    assert sorted((str(r["doc_id"]), r["text_sha256"]) for r in found) == sorted((i, h) for i, _, _, h in want)
    groups = {r["text_sha256"] for r in found}
    assert sum(r["kept"] for r in found) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    # a digest that nearly all texts share: byte verification puts it right
    weak = lsm_dedup.dedup(docs, digest=lambda norm: F.encode(F.substring(F.sha2(norm, 256), 1, 1), "UTF-8")).collect()
    assert told(weak) == told(found) and sum(r["kept"] for r in weak) == len(groups)
    assert lsm_dedup.dedup(nothing).count() == 0
    assert min(r["keep_id"] for r in lsm_dedup.dedup(docs, keep="smallest").collect() if r["doc_id"] == 85) == 80
    clash = docs.withColumn("block", F.lit("b")).withColumn("row", F.lit("r")).withColumn("best", F.lit(1)).withColumn("ident", F.lit(1)).withColumn("filter_word", F.lit(1)).withColumn("in_1", F.lit("i"))
    kept = lsm_dedup.keep_one(clash)
    assert kept.columns == clash.columns and kept.count() == len(groups) == kept.where("block = 'b' AND row = 'r' AND in_1 = 'i'").count()
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in found if r["kept"])


def test_exact_dedup_under_one_digest(spark, monkeypatch):
    rows = [(1, "aaa", "en"), (1, "bbb", "en"), (2, "ccc", "en"), (2, "CCC", "en"), (3, "bbb", "en")]
    for hot in (4096, 1):  # by a shuffle, and by the broadcast of hot digests
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        found = lsm_dedup.dedup(frame(spark, rows), digest=lambda norm: F.encode(F.lit("x"), "UTF-8")).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == [(1, 1, 1), (1, 3, 2), (2, 2, 2), (2, 2, 2), (3, 3, 2)]
        assert sum(r["kept"] for r in found) == 3
        one = lsm_dedup.dedup(frame(spark, rows)).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in one) == sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in found)


def test_lsm_index_takes_further_batches(spark):
    rng = random.Random(9)
    batches = [[(100 * b + k, f"text {rng.randrange(60)}", "en") for k in range(40)] for b in range(5)]
    index, seen = lsm_dedup.LsmIndex(spark, fanout=2), set()
    for b, rows in enumerate(batches):
        if b == 3:  # go on with the index as it was left
            index = lsm_dedup.LsmIndex.open(spark, index.root, index.version, fanout=2)
        kept = {r["text"]: r["doc_id"] for r in lsm_dedup.new_texts(index, frame(spark, rows)).collect()}
        assert kept == {t: max(i for i, u, _ in rows if u == t) for _, t, _ in rows if t not in seen}
        seen |= {t for _, t, _ in rows}
    assert [len(level) for level in index.levels] == [1, 0, 1]  # five flushes, three compactions
    held = {bytes(r["digest"]): r for r in index.compacted().collect()}
    for text in seen:
        r = held.pop(hashlib.sha256(text.encode()).digest())
        assert r["records"] == sum(t == text for rows in batches for _, t, _ in rows) and ~r["best"]["ident"] == max(i for rows in batches for i, t, _ in rows if t == text)
    assert not held


def test_filters(spark):
    keys, others = spark.range(2000), spark.range(2000, 60000)
    words = filters.bloom(keys, F.xxhash64("id"))
    assert filters.passing(keys, F.xxhash64("id"), words).count() == 2000
    assert filters.passing(others, F.xxhash64("id"), words).count() < 600
    assert filters.passing(others, F.xxhash64("id"), filters.bloom(keys.where("false"), F.xxhash64("id"))).count() == 0


def test_jaccard(docs, nothing):
    label = components(ROWS)
    sizes = {str(i): len(shingles(c)) for (i, *_), c in zip(ROWS, CODES, strict=True)}
    for options in ({}, {"sample_docs": 20, "least": 2}):
        found = jaccard.near_duplicates(docs, **options).collect()
        assert len(found) == len(ROWS) and {str(r["doc_id"]): r["n_shingles"] for r in found} == sizes
        assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == label
        assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]
    assert jaccard.near_duplicates(nothing).count() == 0


def test_jaccard_tiles_of_several_blocks(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            words[rng.randrange(60)] = f"c{rng.randrange(1000)}"
        rows.append((k, " ".join(words), "en"))
    for name, value in (("TILE", 20), ("BUFFER", 30), ("LEADERS", 2), ("HELD", 50)):
        monkeypatch.setattr(jaccard, name, value)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert found == components(rows)


def test_jaccard_of_every_path(spark, monkeypatch):
    """Tiles of many blocks and bands, hot shingles, hot copies and one large component beside others, at the boundary."""
    rng = random.Random(12)
    rows = []
    for k in range(160):
        words = [f"w{i}" for i in range(rng.choice([30, 40, 52, 60, 60, 60]))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"c{rng.randrange(40)}"
        rows.append((k, " ".join(words), "en"))
    rows += [(1000 + k, rows[0][1].upper(), "en") for k in range(30)] + [(7, rows[3][1] + " more", "en"), (3, " ".join(f"z{i}" for i in range(50)), "en"), (2000, " ".join(f"z{i}" for i in range(49)), "en")]
    want = components(rows)
    for values in ({"TILE": 8, "LEADERS": 1, "HELD": 50, "HOT_SHINGLE": 10}, {"TILE": 30, "LEADERS": 2, "BUFFER": 30}):
        for name, value in values.items():
            monkeypatch.setattr(jaccard, name, value)
        monkeypatch.setattr(common, "HOT_ROWS", 5)
        found = jaccard.near_duplicates(frame(spark, rows), least=2).collect()
        assert len(found) == len(rows) and {r["doc_id"]: r["component_id"] for r in found} == want
        assert sorted((r["doc_id"], r["n_shingles"]) for r in found) == sorted((i, len(shingles(t))) for i, t, _ in rows)
    assert 10 < len(set(want.values())) < 150


def test_workers_give_memory_back(monkeypatch):
    """A task of near_dedup, the filter by place and the model gives back encoders, and what it held itself when it ends; each did so before its work alone, and for encoders alone."""
    trims = []
    monkeypatch.setattr(encode.ctypes, "CDLL", lambda name: type("C", (), {"malloc_trim": staticmethod(trims.append)}))

    class Taken:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

    encode.encoder("word", public_tokenizers.path("word_bpe_49k.json"))
    run = jaccard.signatures(Taken(), np.empty(0, np.uint64), 75).run
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d e f", None])], ["doc_id", "text"])
    out = run(iter([batch]))
    assert next(out).num_rows == 2
    assert not encode._KEPT
    during = len(trims)
    assert list(out) == []
    assert len(trims) > during


def test_jaccard_sends_small_batches(spark, monkeypatch):
    """The 64 MB of Spark's batches are held twice for each task; the setting of the session is as before afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), []
    real = jaccard.signatures
    monkeypatch.setattr(jaccard, "signatures", lambda *a: seen.append(spark.conf.get(key)) or real(*a))
    rows = [(k, f"one two three four five six {k // 2}") for k in range(6)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}
    assert seen == ["4m"] and spark.conf.get(key) == before


def test_jaccard_pairs_tested_before(spark):
    """The nearest pair of two components fails, another of theirs is at exactly 75 %."""

    def text(changes):
        words = [f"w{k}" for k in range(60)]
        for at, word in changes.items():
            words[at] = word
        return " ".join(words)

    for cases in (({0: "x192", 58: "x636"}, {2: "x185", 54: "x773"}, {2: "x296"}), ({58: "x528", 54: "x985"}, {7: "x258"}, {57: "x714"})):
        rows = [(k, text(c), "en") for k, c in enumerate(cases, 1)]
        found = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
        assert found == components(rows) == {1: 1, 2: 1, 3: 1}


def test_jaccard_best_pair_tested_before(spark):
    """1-3 links, 1-2 seems nearer than 2-3 but fails the test of the first round, and 2-3 links."""
    shared, own = [f"w{k}" for k in range(175)], [f"x{k}" for k in range(29)]
    for seed in range(2000):
        other = [f"y{seed}-{k}" for k in range(29)]
        rows = [(1, " ".join(shared + own), "en"), (2, " ".join(shared + other), "en"), (3, " ".join(shared + own[:-2]), "en")]
        x = [jaccard.Shingler()(t) for _, t, _ in rows]
        maps = jaccard.Bitmaps([jaccard.bitmap(s) for s in x])
        n = np.array([len(s) for s in x])
        near = {(a, b): jaccard.similarity(n[a], n[[b]], *maps.differing(a, np.array([b])))[0] for a, b in ((0, 1), (1, 2))}
        if 0.75 <= near[0, 1] < 0.79 and near[1, 2] < min(near[0, 1], 0.75):
            break
    assert [jaccard.links(x[a], x[b]) for a, b in ((0, 2), (0, 1), (1, 2))] == [True, False, True] and near[1, 2] < 0.75 <= near[0, 1]
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert found == components(rows) == {1: 1, 2: 1, 3: 1}


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        maps = jaccard.Bitmaps([jaccard.bitmap(x), jaccard.bitmap(y)])
        differ, _ = maps.differing(0, np.array([1]))
        assert differ[0] <= len(np.setxor1d(x, y))
        linked = 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
        assert jaccard.links(x, y) == linked and (not linked or jaccard.may_link(len(x), np.array([len(y)]), differ, 75)[0])


def brute_kneser_ney(trusted, everything):
    """Bits of a text, from an interpolated modified Kneser-Ney model of order 4 over code points held in plain dicts."""
    padded = lambda t: ["<s>"] * 3 + list(t)
    counts = {4: Counter(tuple(p[i - 3 : i + 1]) for t in trusted for p in [padded(t)] for i in range(3, len(p)))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d, total, given = {}, {}, {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(x == k for x in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y)
        d[n] = [min(max(x, 0.05), k) for x, k in zip(raw, (0.95, 1.95, 2.95), strict=True)]
        for g, x in c.items():
            total[g[:-1]] = total.get(g[:-1], 0) + x
            given[g[:-1]] = given.get(g[:-1], 0) + min(d[n][min(x, 3) - 1], x)
    symbols = len(set("".join(everything)))

    def p(g):
        n, h = len(g), g[:-1]
        lower = p(g[1:]) if n > 1 else 1 / symbols
        if not total.get(h):
            return lower
        x = counts[n].get(g, 0)
        return ((x - min(d[n][min(x, 3) - 1], x)) if x else 0) / total[h] + given[h] / total[h] * lower

    return lambda t: sum(-math.log2(p(tuple(q[i - 3 : i + 1]))) for q in [padded(t)] for i in range(3, len(q)))


#: Texts in several scripts, beyond U+FFFF, and with the code points that tables might use as marks.
SCRIPT_ROWS = [(200, "привет мир и снова мир, привет", "ru"), (201, "漢字と仮名の文、漢字", "ja"), (202, "\U0001f642\U0001f643 \U0001f642 \U00020000\U00020001", None), (203, "\0\0a\0\uffff\U0010ffff b", "en"), (204, "привет", "ru")]


def test_kneser_ney(docs, nothing, spark):
    docs = docs.unionByName(frame(spark, SCRIPT_ROWS))
    rows = ROWS + SCRIPT_ROWS
    labels = spark.createDataFrame([(k, 1, 0) for k in [*range(60), 200, 201, 203]] + [(100, 1, 0), (101, 1, 1), (202, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    good = {*range(60), 100, 200, 201, 203}
    found = kneser_ney.perplexity(docs, labels, least=5).collect()
    bits = brute_kneser_ney([t or "" for i, t, _ in rows if i in good], [t or "" for _, t, _ in rows])
    limits, of = {}, {}
    told = sorted(found, key=lambda r: (str(r["doc_id"]), r["n_chars"], str(r["lang"])))
    for r, (i, t, lang) in zip(told, sorted(rows, key=lambda r: (str(r[0]), len(r[1] or ""), str(r[2]))), strict=True):
        assert (r["doc_id"], r["lang"], r["n_chars"]) == (i, lang, len(t or ""))
        if not t:
            assert r["perplexity"] is None and r["kept"]
        else:
            assert r["perplexity"] == pytest.approx(2 ** (bits(t) / len(t)), rel=1e-5)
            if i in good:
                of.setdefault(lang, []).append(r["perplexity"])
    at = lambda x: sorted(x)[math.ceil(kneser_ney.QUANTILE * len(x)) - 1]
    limits = {lang: at(x) for lang, x in of.items() if len(x) >= 5 and lang}
    other = at([x for xs in of.values() for x in xs])
    for r in found:
        if r["perplexity"] is not None:
            limit = limits.get(r["lang"], other) * (1 + kneser_ney.SHORT / r["n_chars"] ** 0.5)
            assert r["threshold"] == pytest.approx(limit) and r["kept"] == (r["perplexity"] <= r["threshold"])
    assert not next(r for r in found if r["doc_id"] == 110)["kept"]
    assert kneser_ney.perplexity(nothing, labels).count() == 0
    assert all(r["kept"] for r in kneser_ney.perplexity(docs, labels.where("false")).collect())
    clash = docs.withColumn("kn_lang", F.lit("x")).withColumn("perplexity", F.lit(1)).withColumn("block", F.lit("b")).withColumn("row", F.lit("r")).withColumn("in_0", F.lit(0)).withColumn("threshold", F.lit(2))
    kept = kneser_ney.keep_good(clash, labels, least=5)
    assert kept.columns == clash.columns and kept.count() == sum(r["kept"] for r in found)
    assert {(r["block"], r["row"], r["in_0"], r["kn_lang"]) for r in kept.collect()} == {("b", "r", 0, "x")}


def test_kneser_ney_windows(monkeypatch):
    """Grams do not depend on where windows end, nor on how many symbols a window has."""
    strings = ["abcabd", "", "x", "привет \U0001f642" * 5, "é" * 40]
    points, inside, sizes = kneser_ney.symbols_of(strings)

    def every():
        out = []
        for window, s, e in kneser_ney.windows(points, inside):
            assert len(window.packed) == inside[s:e].sum()
            h, w = window.unpacked(window.packed)
            packed, here = window.known(h, w)
            assert here.all() and (packed == window.packed).all()
            out += list(zip(h.tolist(), w.tolist(), strict=True))
        return out

    whole = every()
    assert len(whole) == sizes.sum()
    monkeypatch.setattr(kneser_ney, "WINDOW", 7)
    assert every() == whole


def test_attach_broadcasts_and_salts_alike(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("3", 2), ("none", 3)], "k string, v int")
    both = [sorted((r["id"], str(r["k"]), r["v"]) for r in attach(rows, small, ["k"], **o).collect()) for o in ({}, {"most_rows": 1, "salts": 7}, {"most_bytes": 1})]
    assert both[0] == both[1] == both[2] and len(both[0]) == 500 and sum(v == 1 for _, _, v in both[0]) == 333


def test_kneser_ney_limit_is_the_quantile(docs, spark):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    found = [r for r in kneser_ney.perplexity(docs, labels).collect() if r["perplexity"] is not None]
    most = max(r["perplexity"] for r in found if r["doc_id"] in range(60))
    for r in found:
        assert r["threshold"] <= most * (1 + kneser_ney.SHORT / r["n_chars"] ** 0.5) * (1 + 1e-9)
        assert r["kept"] == (r["perplexity"] <= r["threshold"])


def test_kneser_ney_limits_are_exact(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), draw.choice([draw.uniform(2, 50), 7.5, 9.25])) for _ in range(6000)] + [("c", 3.0), ("d", 1.0), ("d", 1.0)]
    of = {(False, lang): [p for x, p in rows if x == lang] for lang in "abcd"} | {(True, ""): [p for x, p in rows if x is not None] + [p for x, p in rows if x is None]}
    want = {k: (len(x), sorted(x)[max(1, math.ceil(0.99 * len(x))) - 1]) for k, x in of.items()}
    table = spark.createDataFrame(rows, "lang string, perplexity double")
    for parts in (1, 7):
        found = kneser_ney.limits(table.repartition(parts), 0.99).collect()
        assert {(r["whole"], r["lang"]): (r["n"], r["limit"]) for r in found} == want and len(found) == len(want)
    assert kneser_ney.limits(table.where("false"), 0.99).count() == 0


def test_kneser_ney_does_not_depend_on_the_order(docs, spark):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    told = [sorted(map(str, kneser_ney.perplexity(d, labels, least=5).collect())) for d in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).repartition(5))]
    assert told[0] == told[1]


def test_warc(spark):
    page = "<html>" + "x" * 200
    rows = [(1, "http://www.b.example.com/a?q=1#f", page), (2, "https://c.example.com:8080/", page), (3, None, page), (4, "http://b.example.com/a?q=1", None), (5, "not a url \t at all", "short"), (6, "http://[bad", "short"), (None, "http://x.org/", "z" * 120), (7, "http://x.org/", "é" * 100), (7, "http://x.org/", "é" * 100), (8, "http://long.org/", "long page " * 50_000), (9, "http://long.org/", "long page " * 50_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    found = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    wanted = sorted((str(i), len(h := (t or "").encode()), hashlib.sha256(h).hexdigest(), "revisit" if i in (2, 3, 9) else "response", {2: 1, 3: 1, 9: 8}.get(i)) for i, _, t in rows)
    assert found == wanted
    assert warc.round_trip(pages.where("false")).count() == 0
    assert warc.url_key("http://www.a.example.com/x?y") == "com,example,a)/x?y"
    many = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.col("id") % 40).alias("url"), F.lit("same page of more than one hundred bytes " * 3).alias("html"))
    from graphline.llm.common import shared_dir

    root = shared_dir(spark, "w")
    upper = warc.build_index(warc.write(many, root), root, block_lines=7)
    assert warc.read(warc.look_up(many, root, upper), root).where("record_type = 'revisit' AND refers_to = 0").count() == 499
    assert warc.Index(root, upper).find("org,h)/nothing", 3) == []
