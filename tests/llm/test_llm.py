"""The corpus operators against brute-force versions, exact round trips and held-out accuracy."""

import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoflow.llm import ann, bpe, langid, license_scan, linededup, media, minhash, packing, quality, suffix
from lithoflow.llm import queries as Q

WORDS = "the of ré thing onhe is a llamar ouéau plain words und nicht".split()
SPACE = "[\x20\x09-\x0d]"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit(1).alias("id"), F.lit("x").alias("block"), F.lit(2).alias("key"), F.lit(3).alias("piece"), F.lit("q").alias("words"))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "ONE"), (905, "a\n\nA \n"), (905, "a\n\nA \n"), (906, "x" * 5000), (907, "é" * 3000 + "\n" * 50), (908, "日本語 テスト 😀"), (909, "a <|endoftext|> b")]


def corpus(seed=3, n=80):
    rng = random.Random(seed)
    passages = [prose(rng, 20) for _ in range(4)]
    rows = []
    for i in range(n):
        t = prose(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(["", " ", "\n"]) + rng.choice(passages) + rng.choice(["\n", " "]) + prose(rng, rng.randint(0, 12))
        rows.append((i, t))
    rows += [(200 + i, rows[i][1]) for i in range(5)] + [(300 + i, rows[i][1] + " end") for i in range(5)]
    return rows + ODD


@pytest.fixture(scope="module")
def path():
    return Q.vocabulary_path()


# 1
def licences(rows, contained=0.8):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = set()
    for name, template in license_scan.TEMPLATES.items():
        want = {*grams(cut(template))}
        block = 1
        while block < 1.25 * len(want):
            block *= 2
        for i, t in rows:
            have = grams(cut(t))
            spots = [(len(want & {*have[s : s + 2 * block]}) / len(want), s) for s in range(0, max(1, len(have)), block)]
            found = [(share, s) for share, s in spots if share >= contained]
            if found:
                out.add((i, name, round(max(x for x, _ in found), 6), len(found), min(s for _, s in found)))
    return out


def test_license_scan(spark):
    rng = random.Random(1)
    rows = corpus(n=20)
    for n, (name, t) in enumerate(license_scan.TEMPLATES.items()):
        w = t.split()
        if len(w) > 20:
            w[7] = "changed"
        rows.append((400 + n, prose(rng, rng.randint(0, 40)) + " " + " ".join(w) + " " + prose(rng, 30)))
        rows.append((500 + n, " ".join(t.split()[: len(w) // 3])))
    got = {tuple(r) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == licences(rows) and {i for i, *_ in got} >= set(range(400, 400 + len(license_scan.TEMPLATES)))
    assert license_scan.scan(frame(spark, rows).limit(0)).count() == 0 == license_scan.scan(frame(spark, rows), {}).count()
    with pytest.raises(ValueError):
        license_scan.scan(frame(spark, rows), {"x": "too short"})


def test_many_templates_are_joined(spark, monkeypatch):
    """Beyond the broadcast limit, a shuffled join on bands gives the same rows."""
    rng = random.Random(2)
    rows = corpus(n=10) + [(400 + n, prose(rng, rng.randint(0, 40)) + " " + t + " " + prose(rng, 30)) for n, t in enumerate(license_scan.TEMPLATES.values())]
    rows += [(None, license_scan.TEMPLATES["mit"]), (None, license_scan.TEMPLATES["isc"]), (450, "word " * 200_000 + license_scan.TEMPLATES["isc"])]
    few = sorted(map(tuple, license_scan.scan(frame(spark, rows)).collect()), key=str)
    monkeypatch.setattr(license_scan, "MOST_TEMPLATE_WORDS", 10)
    many = license_scan.scan(frame(spark, rows))
    assert sorted(map(tuple, many.collect()), key=str) == few and len(few) > 12 and not re.search("NestedLoop|Cartesian", many._jdf.queryExecution().toString())


# 2
def test_media_of_texts(spark):
    rows = corpus(n=20)
    found = media.media_features(media.text_media(frame(spark, rows)), samples=True).collect()
    assert sorted((r["id"], r["n_bytes"]) for r in found) == sorted((i, len((t or "").encode())) for i, t in rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, (t or "").encode())
    for r in found:
        raw = texts[r["id"]]
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert bytes(r["samples"]) == padded and r["samples_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        assert r["media_bytes"] == len(stored) and r["media_sha256"] == hashlib.sha256(stored).hexdigest() and len(r["dhash"]) == 16
        assert np.load(__import__("io").BytesIO(bytes(r["tile"]))).shape == (32, 32)


def test_area_resize_is_exact():
    rng = np.random.default_rng(0)
    for h, w, a, b in [(8, 9, 8, 9), (16, 18, 8, 9), (5, 7, 8, 9), (64, 33, 3, 5), (1, 1, 8, 9)]:
        x = rng.integers(0, 256, (h, w)).astype(float)
        fine = np.kron(x, np.ones((a, b)))  # each cell as a x b equal parts
        want = fine.reshape(a, h, b, w).mean((1, 3))
        assert np.allclose(media.area_resize(x, a, b), want)


def test_decoders():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    assert (media.decode(b"P6 # c\n6 5\n255\n" + x.tobytes()) == x).all()
    assert (media.decode(b"P3 6 5 255 " + b" ".join(b"%d" % v for v in x.ravel())) == x).all()
    g = x[:, :, :1]
    assert (media.decode(b"P2\n6 5\n255\n" + b"\n".join(b"%d" % v for v in g.ravel())) == g).all()
    deep = rng.integers(0, 65536, (2, 3, 1)).astype(">u2")
    assert (media.decode(b"P5 3 2 65535\n" + deep.tobytes()) == deep).all()
    bits = rng.integers(0, 2, (3, 10))
    want = ((1 - bits) * 255)[:, :, None]
    assert (media.decode(b"P4 10 3\n" + np.packbits(bits, axis=1).tobytes()) == want).all()
    assert (media.decode(b"P1 10 3\n" + "".join(map(str, bits.ravel())).encode()) == want).all()
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" * (-18 % 4) for r in x[::-1])
    head = lambda w, h, depth, offset, colours=0: b"BM" + struct.pack("<IHHI", 0, 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, depth, 0, 0, 0, 0, colours, 0)
    assert (media.decode(head(6, 5, 24, 54) + rows) == x).all()
    index = rng.integers(0, 4, (5, 6)).astype(np.uint8)
    palette = rng.integers(0, 256, (4, 4)).astype(np.uint8)
    body = b"".join(r.tobytes() + b"\0\0" for r in index)
    assert (media.decode(head(6, -5, 8, 70, 4) + palette.tobytes() + body) == palette[index][:, :, 2::-1]).all()


def plain_resize(x, height, width):
    """Mean over each target cell's area, cell by cell."""
    from fractions import Fraction as Q

    h, w = x.shape
    share = lambda i, n, m, j: max(Q(0), min(Q((j + 1) * n, m), i + 1) - max(Q(j * n, m), i))
    return [[sum(share(i, h, height, a) * share(j, w, width, b) * int(x[i, j]) for i in range(h) for j in range(w)) / Q(h * w, height * width) for b in range(width)] for a in range(height)]


def test_hash_and_tile_are_the_definition(monkeypatch):
    monkeypatch.setattr(media, "STRIP", 7)
    rng = np.random.default_rng(3)
    for h, w in [(1, 64), (5, 64), (33, 20), (8, 9)]:
        x = rng.integers(0, 256, (h, w)).astype(np.uint8)
        small = plain_resize(x, 8, 9)
        bits = [round(float(r[i + 1]), 6) > round(float(r[i]), 6) for r in small for i in range(8)]
        assert media.difference_hash(x[:, :, None]) == np.packbits(bits).tobytes().hex()
        assert np.allclose(media.area_resize(x[:, :, None], 8, 9), np.array(small, float))
    data = media.encode_pgm(media.payload_of("some text " * 50)[0])
    image = media.decode(data)
    want = np.round(np.array(plain_resize(image[:, :, 0], 32, 32), float)).astype(np.uint8)
    tile = np.round(media.area_resize(image, 32, 32)).astype(np.uint8)
    assert (np.abs(tile.astype(int) - want) <= 1).all() and (tile == want).mean() > 0.99


def test_samples_are_scaled():
    assert media.decode(b"P5 3 1 15\n" + bytes([0, 7, 15])).ravel().tolist() == [0, 119, 255]
    assert media.decode(b"P2 2 1 1000 0 1000").ravel().tolist() == [0, 65535]
    head = b"BM" + struct.pack("<IHHI", 0, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 32, 3, 0, 0, 0, 0, 0)
    masks = struct.pack("<III", 0xFF, 0xFF00, 0x3FF0000)  # red lowest, ten bits of blue
    assert media.decode(head + masks + struct.pack("<II", 0x03FF0201, 0)).tolist() == [[[1, 2, 255], [0, 0, 0]]]
    head = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 16, 0, 0, 0, 0, 0, 0)
    assert media.decode(head + struct.pack("<HH", 0x7C1F, 0)).tolist() == [[[255, 0, 255]]]


HOSTILE = [b"P5 99999999999 99999999999 255\n", b"P2 1 1 255 99999999999999999999", b"P5 1 1 10\n\xff", b"P2 1 1 255 300", b"P2 1 1 255 -3", b"P6 9 9 0 1", b"P4 9", b"P5", b"BM", b"BM" + b"\xff" * 60, b"BM" + b"\0" * 60,
           b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2**31 - 1, -(2**31), 1, 32, 0, 0, 0, 0, 0, 0)]


def test_hostile_media_are_rows(spark):
    df = spark.createDataFrame([(i, 0, bytearray(x)) for i, x in enumerate(HOSTILE)], "id long, n_bytes long, media binary")
    got = media.media_features(df).collect()
    assert len(got) == len(HOSTILE) and all(r["error"] and r["dhash"] is None and r["media_bytes"] for r in got)


def test_long_text_media(spark):
    rows = [(1, "é" * 1_000_000), (2, " " * 2_000_000), (3, None)]
    got = {r["id"]: r for r in media.media_features(media.text_media(frame(spark, rows))).collect()}
    assert [got[i]["samples_bytes"] for i in (1, 2, 3)] == [2_000_000, 2_000_000, 64] and got[2]["height"] == 2_000_000 // 64
    assert media.text_media(frame(spark, rows).limit(0)).count() == 0


def test_bad_media_are_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"nothing")), (3, 0, bytearray(b"P5 9 9 255\n1")), (4, 64, bytearray(media.encode_pgm(b"x" * 64)))], "id long, n_bytes long, media binary")
    got = {r["id"]: r["error"] for r in media.media_features(df).collect()}
    assert got[1] and got[2] and got[3] and got[4] is None
    media.write_tiles(df, str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 4


# 3
def test_best_fit_and_bound():
    rng = np.random.default_rng(0)
    for cap, lengths in [(2048, rng.integers(1, 2049, 700)), (10, np.array([6] * 5 + [4] * 5 + [3] * 3)), (10, np.array([4] * 9)), (7, rng.integers(1, 8, 12)), (1, np.array([1, 1]))]:
        where, offset, bins = packing.best_fit_decreasing(lengths, cap)
        for b in range(bins):
            at = np.flatnonzero(where == b)
            at = at[np.argsort(offset[at])]
            assert offset[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist() and lengths[at].sum() <= cap
        assert packing.lower_bound(lengths, cap) <= bins


def test_lower_bound_is_a_bound():
    from functools import lru_cache

    rng = random.Random(2)
    for _ in range(60):
        cap = rng.randint(5, 20)
        items = tuple(sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 7))), reverse=True))

        @lru_cache(None)
        def best(rest, rooms):
            if not rest:
                return 0
            options = [1 + best(rest[1:], tuple(sorted([*rooms, cap - rest[0]])))]
            options += [best(rest[1:], tuple(sorted([*rooms[:i], r - rest[0], *rooms[i + 1 :]]))) for i, r in enumerate(rooms) if r >= rest[0]]
            return min(options)

        assert packing.lower_bound(np.array(items), cap) <= best(items, ()) <= packing.best_fit_decreasing(np.array(items), cap)[2]


def test_packing(spark, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = corpus(n=30)
    got = packing.packed_pieces(frame(spark, rows), path, capacity=64).collect()
    ids, places = {}, {}
    for i, text in rows:
        ids[i] = t.encode(text or "", add_special_tokens=False).ids + [0]
    copies = {i: sum(j == i for j, _ in rows) for i, _ in rows}
    for i, own in ids.items():
        mine = sorted((r for r in got if r["id"] == i), key=lambda r: r["piece"])
        cuts = packing.cut(len(own), 64)
        assert len(mine) == len(cuts) * copies[i] and all(n == 64 for _, n in cuts[1:])
        for r in mine:
            start, length = cuts[r["piece"]]
            assert (r["start"], r["length"]) == (start, length) and r["ids_crc32"] == zlib.crc32(np.array(own[start : start + length], "<u4").tobytes())
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 64
    total = sum(r["length"] for r in got)
    assert len(places) <= -(-total // 64) + 2
    assert packing.packed_pieces(frame(spark, rows).limit(0), path).count() == 0


def test_exchange_saves_bins(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(rng.integers(20, 60, 400))], "id long, piece int, length long")
    got = packing.pack(rows, capacity=100, items=20)
    alone = packing.pack(rows, capacity=100, items=20, rounds=0)
    assert got.count() == 400 and got.select("sequence_id").distinct().count() <= alone.select("sequence_id").distinct().count()
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 100


def test_exchange_nears_the_global_bound(spark):
    """Partitions alone use more bins than the bound of all rows; the exchange closes half of the gap at least."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(rng.integers(1, 100, 1500))], "id long, piece int, length long")
    bound = packing.global_bound(rows, 100)
    got = packing.pack(rows, capacity=100, items=400)
    alone = packing.pack(rows, capacity=100, items=400, rounds=0)
    assert got.count() == 1500 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 100
    used, without = (x.select("sequence_id").distinct().count() for x in (got, alone))
    assert bound <= used < without and used - bound <= (without - bound) / 2
    assert got.select("lower_bound").distinct().collect() == [(bound,)]
    big = spark.createDataFrame([(i, 0, 60) for i in range(300)], "id long, piece int, length long")
    assert packing.pack(big, capacity=100, items=20).select("sequence_id").distinct().count() == 300 == packing.global_bound(big, 100)


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 1_200_000 + "word", "x" * 2_000_000, "é " * 500_000])
def test_ids_of_long_texts(path, text):
    assert packing.text_ids(text, path) == packing._library(path).encode(text, add_special_tokens=False).ids


def test_packing_of_long_white_space(spark, path):
    got = packing.packed_pieces(frame(spark, [(1, " " * 1_000_000 + "x"), (2, "a b"), (3, None)]), path).collect()
    n = len(packing._library(path).encode(" " * 1_000_000 + "x", add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in got if r["id"] == 1) == n and {r["id"] for r in got} == {1, 2, 3}


# 4
def test_bpe_as_library(spark, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = "aabbeett   theing!!??..''’éèß中文日\n\t\r\x0b\x85  😀0123٣½²_-"
    texts = [x or "" for _, x in corpus()] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["<|endoftext|>x <|endoftext|><|endoftext|>", "'s'LL'll'd", "  " * 40]
    rows = [*enumerate(texts)]
    ids = bpe.encode(frame(spark, rows), path)
    got = {r["id"]: r["ids"] for r in ids.collect()}
    for i, text in rows:
        assert got[i] == t.encode(text, add_special_tokens=False).ids, text
    back = {r["id"]: r["text"] for r in bpe.decode(ids, path).collect()}
    assert back == {i: t.decode(got[i], skip_special_tokens=False) for i, _ in rows}
    assert bpe.encode(frame(spark, [(1, None)]), path).first()["ids"] == []


@pytest.mark.parametrize("text", ["x" * 300_000, " " * 200_000 + "x", "ab" * 30_000 + "c" * 65, "=-" * 5000, "é" * 40_000, "日本語" * 30_000, "".join(random.Random(5).choices("etaoinshr", k=60_000))])
def test_long_words_as_library(path, text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    e = bpe.Encoder(path)
    assert np.frombuffer(e.encode_batch([text])[0], "<u4").tolist() == want
    shared = [text[:-1], text, text + "x", text[: len(text) // 2]]  # prefixes share their states
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(path).encode_batch(shared)][1] == want


def test_bpe_of_nothing(spark, path):
    assert bpe.encode(frame(spark, [(1, "a")]).limit(0), path).count() == 0
    assert [list(r["ids"]) for r in bpe.encode(frame(spark, [(1, "a b"), (1, "a b"), (None, "a b")]), path).collect()] == [bpe.encode(frame(spark, [(1, "a b")]), path).first()["ids"]] * 3


def test_cache_overflow_changes_nothing(path, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    e = bpe.Encoder(path)
    once = e.encode_batch(["one two three four five"])
    assert e.encode_batch(["six seven", "one two three four five"])[1] == once[0]


# 5
def duplicates(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(SPACE + "+", low(t or "")) if x]
        sets[i] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i)) for i in ids}


def families(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{j}" for j in range(60)] + ["The", "of"]
    rows = []
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 30, 80, 200]))]
        for _ in range(rng.randint(1, 30)):
            w = base[:]
            for _ in range(rng.randint(0, max(1, len(w) // 7))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [r for r in ODD if r[0] != 905]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rows = families()
    assert {tuple(r) for r in minhash.near_duplicates(frame(spark, rows), k).collect()} == duplicates(rows, k)


def test_near_duplicates_of_repeated_ids(spark):
    """A row that is a copy does not keep the other texts of its id from their links."""
    a, b = (" ".join(f"{c}{j}" for j in range(40)) for c in "ab")
    rows = [(1, a), (5, a), (5, b), (5, b), (12, b), (9, b + " end"), (30, a[::-1])]
    got = {(r["id"], r["component"]) for r in minhash.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == {(1, 1), (5, 1), (12, 1), (9, 1), (30, 30)}


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [(1, "a")]).limit(0), 2).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(frame(spark, [(None, "a b"), (3, "a b"), (3, "a b")]), 2).filter("id IS NULL").collect()] == [(None, 1, None)]


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    for n in (3, 20, 300):
        errors = []
        for _ in range(40):
            a = rng.integers(-(2**63), 2**63 - 1, n)
            same = 2 * n // 3
            b = np.concatenate([a[:same], rng.integers(-(2**63), 2**63 - 1, n - same)])
            s = minhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], n), 2, 128)
            errors.append((s[0] == s[1]).mean() - same / (2 * n - same))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_signature_is_the_definition():
    """Level by level equals element by element, and does not depend on the other sets of a batch."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**62, 7), rng.integers(0, 2**62, 50)
    both = minhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], [7, 50]), 2, 32)
    assert (both[0] == minhash.signatures(a, np.zeros(7, int), 1, 32)[0]).all() and (both[1] == minhash.signatures(b[::-1].copy(), np.zeros(50, int), 1, 32)[0]).all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (7, 7)], "a long, b long")
    got = dict(map(tuple, minhash.components(links.repartition(7)).collect()))
    assert got == {i: 0 for i in range(61)} | {99: 99, 100: 99}


def test_components_of_a_large_star(spark):
    """A centre with most edges is salted, and the result is the same."""
    links = spark.createDataFrame([(5000, i) for i in range(1, 900)] + [(i, 10_000 + i) for i in range(1, 50)] + [(7001, 7000)], "a long, b long")
    got = dict(map(tuple, minhash.components(links.repartition(9)).collect()))
    assert got == {i: 1 for i in [*range(1, 900), 5000, *range(10_001, 10_050)]} | {7000: 7000, 7001: 7000}


# 6
def nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            out[i] = sorted(((-(q * v).sum(), j) for j, v in good if j != i))[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, rows[3][1]) for i in range(60)] + [(700, None), (720, [0.0] * 8), (740, [float("nan")] + [1.0] * 7), (760, [None] + [1.0] * 7), (780, [1.0] * 5), (800, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("list", F.lit(2))
    got = {}
    for r in ann.search(None, df, k=20, probe=1.0, block=100, queried=F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = nearest(rows, 20)
    assert got.keys() == want.keys()
    hit = sum(len({j for _, j in want[q]} & {j for _, j, _ in got[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.99
    vectors = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v}
    for q, found in got.items():
        found.sort()
        assert [n for n, _, _ in found] == list(range(1, len(want[q]) + 1)) and all(abs(s - (vectors[q] * vectors[j]).sum()) < 1e-12 for _, j, s in found)
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_exact_way_is_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()]
    m, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    got = {}
    for r in ann.search(None, df, k=20, probe=1, alpha=0, block=64, queried=F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q, v in rows:
        if q % 20 == 0:
            scores = (m * v).sum(1)
            assert [got[q][n + 1] for n in range(20)] == [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]


def test_scan_abandons_and_probes_few():
    """On clustered vectors a small share of the cells is computed and a small share of the rows is probed."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 64)) * 3
    x = centres[rng.integers(0, 40, 8000)] + rng.standard_normal((8000, 64))
    index = ann.Index(x[:4000], np.linalg.norm(x, axis=1).max(), 2)
    lists = index.lists_of(index.stored(x))
    sizes = np.bincount(lists, minlength=len(index.fine))
    q = x[::80]
    asks = index.probes(q, sizes, 20, ann.MISS)
    bound = index.scan(q, x[::8], lists[::8], np.ones(asks.shape, bool), np.full(len(q), np.inf), 20)[1][:, -1]
    at, *_ = index.scan(q, x, lists, asks, bound, 20)
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len({*a} & {*b}) / 20 for a, b in zip(at.tolist(), best.tolist())]) >= 0.9
    assert (asks * sizes).sum() < 0.1 * len(q) * len(x)
    _, _, done, every = index.scan(q, x, lists, np.ones(asks.shape, bool), bound, 20)
    assert every == len(q) * len(x) * 65 and done < 0.4 * every


def test_lists_grow_with_the_rows():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 8))
    few, many = (ann.Index(x, 9.0, shards) for shards in (1, 8))
    assert len(few.fine) == ann.LISTS and len(many.fine) == 8 * ann.LISTS


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(None, df, k=20, queried=F.col("id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert ann.search(None, df.limit(0), k=20, queried=F.col("id") % 20 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    got = {}
    for r in Q.op6_nearest(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = []
    for q in ids[ids % 20 == 0]:
        order = [i for i in ids[np.lexsort((ids, -(m @ x[q])))] if i != q][:20]
        hit.append(len(got[q] & {*order}) / len(order))
    assert np.mean(hit) >= 0.9


# 7
def test_quality_held_out(spark):
    data = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else pytest.skip("no tables")
    docs, graded = spark.read.parquet(f"{data}/documents.parquet"), quality.grades(spark.read.parquet(f"{data}/labels.parquet"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    model = quality.train(docs, graded.filter(~held))
    assert (np.diff(model.thresholds) > 0).all()
    found = quality.score_documents(docs, model).join(graded.filter(held).withColumnRenamed("doc_id", "id"), "id").collect()
    good = [r["tail"] >= quality.KEEP for r in found if r["grade"] == 2]
    bad = [r["tail"] < quality.KEEP for r in found if r["grade"] < 2]
    toxic = [r["tail"] < quality.KEEP for r in found if r["grade"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) > 0.75 and np.mean(toxic) > 0.85  # 4,000 labels; better with more


def test_slope_of_the_likelihood():
    """Against differences, at random points; and the fit ends near a point without slope, below the model without weights."""
    rng = np.random.default_rng(3)
    n, tokens = 60, 7
    column, row = rng.integers(0, tokens, 200), rng.integers(0, n, 200)
    y, mass = rng.integers(0, 4, n), rng.random(n)
    for _ in range(5):
        point = rng.standard_normal(tokens + 3) * 0.7
        at = lambda x: quality.likelihood(x[:tokens], x[tokens:], column, row, y, mass, 0.01)
        step = np.eye(len(point)) * 1e-6
        assert np.allclose(at(point)[1], [(at(point + e)[0] - at(point - e)[0]) / 2e-6 for e in step], atol=1e-6)
        assert np.isclose(at(point)[0], plain_likelihood(point, tokens, column, row, y, mass, 0.01))


def plain_likelihood(point, tokens, column, row, y, mass, penalty):
    """Document by document, from P(grade <= k) = 1 / (1 + exp(score - threshold[k]))."""
    cuts, edges = point[tokens:], [point[tokens]]
    for c in cuts[1:]:
        edges.append(edges[-1] + np.exp(c))
    total = penalty / 2 * (point[:tokens] ** 2).sum()
    for d in range(len(y)):
        score = sum(point[c] for c, r in zip(column, row) if r == d)
        upto = [0.0, *(1 / (1 + np.exp(score - e)) for e in edges), 1.0]
        total -= mass[d] * np.log(upto[y[d] + 1] - upto[y[d]])
    return total


def test_fit_is_the_optimum(monkeypatch):
    """Small steps end where the likelihood has no slope, which its convexity makes the optimum."""
    rng = np.random.default_rng(4)
    rows, y = [], []
    for i in range(300):
        g = i % 3
        rows.append(np.unique(np.array([10 + (g if rng.random() < 0.8 else rng.integers(0, 3)), *(100 + rng.integers(0, 5, 2)), 10_000 + i], np.int32)))
        y.append(g)
    seen = []
    plain = quality.likelihood
    monkeypatch.setattr(quality, "likelihood", lambda *a: seen.append((a, plain(*a))) or seen[-1][1])
    quality.fit(rows, np.array(y), steps=6000, rate=0.002, screen=0.0)
    args, (last, slope) = seen[-1]
    assert np.abs(slope).max() < 2e-3 and last < seen[0][1][0] * 0.8


def test_repeated_labelled_ids(spark):
    docs = spark.createDataFrame([(i % 40, f"word{i % 2} other{i % 7} more") for i in range(400)] + [(7, "again")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, quality.grades(labels))
    assert quality.score_documents(docs, model).count() == 900


def test_only_copies_are_left_out_of_the_fit():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.zipf(1.3, 300) % (1 << 24)).astype(np.int32) for _ in range(400)]
    assert len({r.tobytes() for r in rows}) == 400
    assert quality._unlike(rows, np.zeros(400, int)) == [*range(400)]
    assert quality._unlike(rows + rows[:9] + rows[:3], np.array([0] * 409 + [1] * 3)) == [*range(400), 409, 410, 411]


def test_quality_edges(spark):
    docs, labels = frame(spark, corpus(n=20)), spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in quality.grades(labels).collect()} == {(1, 1), (3, 0)}
    none = quality.train(docs, quality.grades(labels).limit(0))
    assert quality.select_documents(docs, none).count() == docs.count() and {*quality.select_documents(docs, none).columns} == {*docs.columns}
    assert quality.score_documents(docs.limit(0), none).count() == 0


def test_thresholds_order_grades():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(600):
        g = rng.integers(0, 3)
        rows.append(np.unique(np.array([10 + g, *(100 + rng.integers(0, 40, 5))], np.int32)))
        y.append(g)
    m = quality.fit(rows, np.array(y))
    tails = m.tails(np.array([m.score(np.array([10 + g], np.int32)) for g in range(3)]))
    assert tails[0, 0] < 0.5 < tails[1, 0] and tails[1, 1] < 0.5 < tails[2, 1]


# 8
def repeats(rows, span=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - span + 1) if i is not None else ():
            first[b[p : p + span]] = min(first.get(b[p : p + span], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        lost = [False] * len(b)
        for p in range(len(b) - span + 1) if i is not None else ():
            if first[b[p : p + span]] < i:
                lost[p : p + span] = [True] * span
        out.append((i, len(b), sum(lost), sum(x and not (k and lost[k - 1]) for k, x in enumerate(lost)), hashlib.sha256(bytes(c for c, x in zip(b, lost) if not x)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [True, False])
def test_repeated_passages(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(suffix, "BLOCK", 20_000)
        monkeypatch.setattr(suffix, "BUCKET", 30_000)
    rng = random.Random(7)
    base = prose(rng, 900)
    rows = corpus() + [(400, base), (401, base[:2000] + "Q" + base[2000:]), (410, "ab" * 2000), (409, "x" + "ab" * 1500), (1, base), (None, base)]
    assert sorted(map(tuple, suffix.repeated_passages(frame(spark, rows)).collect()), key=str) == repeats(rows)


def test_a_common_passage_is_sent_once_a_block():
    rng = random.Random(8)
    passage = prose(rng, 60)
    texts = [(f"{i} " * 20 + passage + f" {i}" * 20).encode() for i in range(300)]
    own = np.arange(300) + 7
    scans = [*suffix._scanned(list(own), texts, [False] * 300, 50, 20)]
    key, twice = suffix._block_anchors(list(own), scans, 3)
    bucket, least, kinds, (piece, doc, _) = suffix._block_fragments(scans, key, twice, own, 3, 50)
    inside = [k for k, n in zip(kinds, least) if k in passage.encode()]
    assert len(inside) == len({*inside}) <= len(passage) // 5 and (least[[k in passage.encode() for k in kinds]] == 7).all()
    assert len(piece) > 250 * len(inside) and (np.diff(bucket) >= 0).all() and {*doc} == {*range(300)}


def test_repeated_passages_of_nothing(spark):
    assert suffix.repeated_passages(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r)[:4] for r in suffix.repeated_passages(frame(spark, [(1, None)])).collect()] == [(1, 0, 0, 0)]


def test_long_documents_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, long), (2, long[3000:7000]), (3, long[:49] + "#" + long[100:149])]
    ids, texts = [1, 2, 3], [t.encode() for _, t in rows]
    whole = {(d, int(s), int(h)) for _, _, _, doc, hs, starts, _ in suffix._scanned(ids, texts, [False] * 3, 50, 12) for d, s, h in zip(doc, starts, hs)}
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    cut = {(d, int(s), int(h)) for _, _, _, doc, hs, starts, _ in suffix._scanned(ids, texts, [False] * 3, 50, 12) for d, s, h in zip(doc, starts, hs)}
    assert {(d, h) for d, _, h in whole} == {(d, h) for d, _, h in cut}


def test_equal_classes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2600] = data[100:700]
    starts = np.arange(len(data) - 49)
    label = suffix.equal_classes(data, starts, 50)
    text, seen = data.tobytes(), {}
    for s, n in zip(starts.tolist(), label.tolist()):
        assert seen.setdefault(text[s : s + 50], n) == n
    assert len(set(label.tolist())) == len(seen)


# 9
def test_language_held_out(spark):
    data = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else pytest.skip("no tables")
    found = Q.op9_language(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in found if r["held_out"] and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    assert len(held) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_language_edges(spark):
    docs = frame(spark, ODD).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy"))
    got = {r["id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and got[903]["lang_pred"] in ("xx", "yy")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def test_all_landmarks_are_exact_kernel_ridge():
    """With every document a landmark, the Nystroem map gives the kernel ridge regression itself."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(30)) for letters in ("abcd ", "cdef ", "efgh ") for _ in range(8)]
    langs = [x for x in "xyz" for _ in range(8)]
    rows = [langid.presence(t) for t in texts]
    model = langid.fit(rows, langs, n_landmarks=len(rows), ridge=0.05)
    k = np.array([[(a & b).sum() / np.sqrt(a.sum() * b.sum()) for b in rows] for a in rows])
    rank = (np.linalg.eigvalsh(k) > 1e-8 * np.linalg.eigvalsh(k).max()).sum()
    y = np.where(np.array(langs)[:, None] == np.array(["x", "y", "z"])[None, :], 1.0, -1.0)
    alpha = np.linalg.solve(k + 0.05 * len(rows) / rank * np.eye(len(rows)), y)
    fresh = ["abca dc", "fefe dcd", "hgh e fg"]
    values = np.array([[(langid.presence(t) & b).sum() / np.sqrt(langid.presence(t).sum() * b.sum()) for b in rows] for t in fresh]) @ alpha
    label, score = model.predict(fresh)
    assert label == ["xyz"[i] for i in values.argmax(1)] and np.allclose(score, np.clip((1 + values.max(1)) / 2, 0, 1), atol=1e-3)


def test_language_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "the same text of words", "aa"), (1, "eine andere Sprache hier", "bb")] * 300 + [(None, "the text", "aa"), (2, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(docs, sample=5)
    got = langid.predict(docs, model).collect()
    assert len(got) == 602 and {r["lang_pred"] for r in got} <= {"aa", "bb"} and model.landmarks.shape[0] == 2
    assert langid.predict(docs.limit(0), model).count() == 0


def test_kernel_is_the_spectrum_kernel():
    a, b = langid.presence("abc ab"), langid.presence("bca")
    assert langid.kernel(np.stack([a]), np.stack([b]).astype(np.float32) / np.sqrt(b.sum()))[0, 0] == pytest.approx((a & b).sum() / np.sqrt(a.sum() * b.sum()))


# 10
def lines(rows, least):
    keys = lambda t: [low(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    docs = {}
    for i, t in rows:
        for k in keys(t):
            docs.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t)) if not (k and len(docs[k]) >= least)]
        out.append((i, len(keys(t)), len(keys(t)) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("least", [1, 3, 10])
def test_line_dedup(spark, least):
    rng = random.Random(4)
    common = ["Share this", " share THIS\t", "© all rights", "x"]
    rows = [(i, "\n".join(rng.choice([*common, prose(rng, 4), "", f"own {i}"]) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [r for r in ODD if r[0] != 905]
    df = frame(spark, rows)
    got = linededup.drop_lines(df, linededup.line_bitmaps(df, min_docs=least))
    assert sorted((r["doc_id"], r["_n_lines"], r["_n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got.collect()) == lines(rows, least)
    assert {*df.columns} < {*got.columns}


def test_lines_of_repeated_ids(spark):
    """Rows of one id are one document, but lose the lines of their own text only."""
    rows = [(i, f"common\nown {i}") for i in range(3)] + [r for r in ODD if r[0] == 905] + [(7, "common\nfirst\nmore"), (7, "unique\nCommon"), (7, "unique\nCommon"), (8, "rare\nx"), (8, "y\nrare")]
    df = frame(spark, rows)
    got = linededup.drop_lines(df, linededup.line_bitmaps(df, min_docs=3))
    assert sorted((r["doc_id"], r["_n_lines"], r["_n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got.collect()) == lines(rows, 3)
    assert sorted(r["text"] for r in got.filter("doc_id = 7").collect()) == ["first\nmore", "unique", "unique"]
    df = frame(spark, [(1, "a\nb"), (1, "a\nc"), (2, "a")])
    got = linededup.drop_lines(df, linededup.line_bitmaps(df, min_docs=1, keep_first=True))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) in ([(1, "a\nb"), (1, "c"), (2, "")], [(1, "a\nc"), (1, "b"), (2, "")])


def test_first_lines_stay(spark):
    df = frame(spark, [(2, "a\nb\na"), (1, "c\nA "), (3, "a")])
    got = linededup.drop_lines(df, linededup.line_bitmaps(df, min_docs=1, keep_first=True))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "c\nA ", 2: "b", 3: ""}
    assert linededup.line_bitmaps(df.limit(0)).count() == 0


def test_lines_are_streamed_in_order(spark):
    """One exchange, by range; the sort and the window stay in the plan; every line is in a range of its key and document."""
    rows = [(i, "hot\nhot\n" + f"own {i}") for i in range(300)]
    found = linededup.line_occurrences(frame(spark, rows))
    ordered = linededup.ordered_lines(found)
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning(key" in plan and "Sort [key" in plan and "Window" in plan
    got = ordered.collect()
    assert len(got) == 900 and sum(r["turn"] == 2 for r in got) == 300
    runs = [(bytes(r["key"]), r["doc"], r["pos"]) for r in got]
    assert runs == sorted(runs) and [r["part"] for r in got] == sorted(r["part"] for r in got)
    hot = {r["part"] for r in got if r["turn"] == 2}
    keys = linededup.common_keys(ordered, 10).collect()
    assert {r["part"] for r in keys} >= hot and len({bytes(r["key"]) for r in keys}) == 1


def test_keep_bitmaps_are_compressed(spark):
    """Equal bytes are one run, bytes that lose nothing are left out."""
    text = "\n".join(["same"] * 800 + [f"own {i}" for i in range(800)] + ["same"])
    df = frame(spark, [(i, text if i == 5 else "same") for i in range(12)])
    keep = {r["doc"]: [tuple(x) for x in r["keep"]] for r in linededup.line_bitmaps(df).collect()}
    assert keep[5] == [(0, 100, 255), (200, 1, 128)] and keep[4] == [(0, 1, 128)]
    got = linededup.drop_lines(df, linededup.line_bitmaps(df)).filter("doc_id = 5").first()
    assert got["text"] == "\n".join(f"own {i}" for i in range(800)) and got["_n_dropped"] == 801


def test_native_operators_run_no_python(spark):
    df = frame(spark, corpus(n=5))
    for out in (license_scan.scan(df), linededup.drop_lines(df, linededup.line_bitmaps(df))):
        assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())
