"""Each operator against a brute-force version, with edge cases, empty tables and clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

from tofloom.llm import components, lines, media, mixing, pieces, quality, simhash, substrings, tokenfile, toxicity, url_filters

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def multiset(rows):
    return Counter(map(tuple, rows))


# -- 1 ------------------------------------------------------------------------


def brute_lines(rows):
    """Removed line numbers of each row, in a defined order of rows."""
    last = 2**63 - 1
    # the order of texts with one id is by line number, then digest: compare only by counts here
    todo = []
    for k, (i, text, *_) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            if words := frozenset(WORD.findall(line)):
                todo.append(((last if i is None else i, n, k), words, k, n))
    todo.sort(key=lambda t: t[0])
    seen, gone = [], defaultdict(set)
    for _, words, k, n in todo:
        if any(9 * len(words & s) >= 4 * (len(words) + len(s)) for s in seen):
            gone[k].add(n)
        seen.append(words)
    return gone


def test_lines(docs, rows, empty):
    got = lines.line_report(docs).collect()
    gone = brute_lines(rows)
    want = [(r[0], sum(bool(WORD.search(x)) for x in (r[1] or "").split("\n")), len(gone[k])) for k, r in enumerate(rows)]
    named = [w for w in want if w[0] is not None]
    assert multiset((r.doc_id, r.n_lines, r.n_removed) for r in got if r.doc_id is not None) == multiset(named)
    assert sum(r.n_removed for r in got) == sum(w[2] for w in want) and len(got) == len(rows)
    assert lines.line_report(empty).count() == 0 and lines.drop_repeated_lines(empty).count() == 0


def test_lines_dropped(docs, rows):
    kept = lines.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    gone = brute_lines(rows)
    want = Counter()
    for k, (i, text, *_) in enumerate(rows):
        all_lines = (text or "").split("\n")
        left = [x for n, x in enumerate(all_lines) if n not in gone[k]]
        if i is not None and (not gone[k] or any(WORD.search(x) for x in left)):
            want[i, text if not gone[k] else "\n".join(left)] += 1
    assert Counter((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_line_join_on_short_alphabet(spark, seed):
    rng = random.Random(seed)
    rows = [(k, "\n".join(" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 14))) for _ in range(6))) for k in range(40)]
    got = {r.doc_id: r.removed_lines for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = brute_lines(rows)
    assert got == {k: ",".join(map(str, sorted(gone[k]))) for k in range(40)}


# -- 2 ------------------------------------------------------------------------


def test_pieces(docs, rows, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter()
    for i, text, *_ in rows:
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert multiset(r[:4] for r in pieces.digest(docs, PIECES).collect()) == want
    assert pieces.digest(empty, PIECES).count() == 0
    assert "ids" in pieces.encode_documents(docs, PIECES).columns


def test_piece_chunks_and_spans():
    own = pieces.codec(PIECES)
    rng = random.Random(0)
    texts = ["", " ", "  ", "a ", " a", "a  b   ", "▁", "a▁▁b", "x\ny  z"] + ["".join(rng.choice(" ▁ab\ncé日<>") for _ in range(rng.randrange(30))) for _ in range(500)]
    for text, ids in zip(texts, own.ids(texts)):
        assert ids.tolist() == own.processor.encode(text)
        starts, ends = own.spans(text, ids)
        assert len(starts) == len(ends) == len(ids)
        if len(ids):
            assert starts[0] == 0 and ends[-1] == len(text.encode()) and (starts[1:] == ends[:-1]).all()
    for text in ("the cat sat", "an été here"):
        (ids,) = own.ids([text])
        starts, ends = own.spans(text, ids)
        whole = text.encode()
        assert [whole[a:b].decode().replace(" ", "▁") for a, b in zip(starts, ends)][1:] == [own.processor.id_to_piece(int(i)) for i in ids][1:]


def test_character_map():
    """A compiled map with keys a->"X", ab->"" and é->"ee": longest prefix wins and offsets point to the source."""
    blob = build_trie({b"a": 0, b"ab": 2, "é".encode(): 3})
    own = pieces.PieceCodec(PIECES)
    own.map = pieces.CharacterMap(struct.pack("<I", len(blob)) + blob + b"X\0\0ee\0")
    flat, source = own.normalise("cabaé".encode())
    assert flat == "▁cXee".encode()
    assert source.tolist() == [0, 0, 0, 0, 3, 4, 4, 6]
    own.trim = True
    flat, source = own.normalise(b"  c  d ")
    assert flat == "▁c▁d".encode() and source.tolist() == [0, 0, 0, 2, 3, 3, 3, 5, 7]


def build_trie(values):
    """A double array by first fit; sizes are tiny."""
    tree = {}
    for key, value in values.items():
        node = tree
        for b in key:
            node = node.setdefault(b, {})
        node[None] = value
    units, used, bases = [0] * 4096, {0}, set()

    def put(node, at):
        labels = [0 if b is None else b for b in node]
        base = next(o for o in range(256, 4096) if o not in bases and all((o ^ x) not in used for x in labels))
        bases.add(base)
        used.update(base ^ x for x in labels)
        units[at] |= (at ^ base) << 10
        if None in node:
            units[at] |= 1 << 8
            units[base] = 1 << 31 | node[None]
        for b, child in node.items():
            if b is not None:
                units[base ^ b] = b
                put(child, base ^ b)

    put(tree, 0)
    return struct.pack("<4096I", *units)


# -- 3 ------------------------------------------------------------------------


def brute_print(text, size):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash(docs, rows, empty, monkeypatch):
    prints = [brute_print(r[1], 4) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), 10**9), r[0])
    want = Counter((r[0], f"{p:016x}", least.get(find(k))) for k, (r, p) in enumerate(zip(rows, prints)))
    for limit in (200_000, 1):
        monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
        assert multiset(simhash.near_duplicates(docs, size=4).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.one_of_each(docs, size=4)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {w[2] for w in want if w[0] is not None}


@pytest.mark.parametrize("leaf,chunk", [(1, 64), (4, 1000), (64, 1 << 20)])
def test_trie_join(leaf, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(leaf)
    values = []
    for base in rng.integers(0, 2**63, 40, dtype=np.uint64):
        for _ in range(12):
            x = int(base)
            for _ in range(rng.integers(0, 7)):
                x ^= 1 << int(rng.integers(0, 64))
            values.append(x)
    values = np.unique(np.array(values, dtype=np.uint64))
    union = simhash._Union(len(values))
    union.add(*np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4))
    forest = simhash._Union(len(values))
    forest.add(*simhash.trie_links(values, np.zeros(len(values), int), 4))
    assert (forest.root == union.root).all()


def test_components(spark):
    path = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in (100, 101, 102)}


# -- 4 ------------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.net", "/e", "block"), ("", "/", "block")]


def brute_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def test_urls(spark, empty):
    urls = [
        None, "", "no scheme", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "https://a.example.com/en/b/c",
        "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/es", "http://a.b.net/english", "http://b.net/d", "http:///path", "x://h?://y/",
        "http://a..com//x//y", "http://example.com:80/en/", "http://a.b.net/es/e?://com/", "x" * 50 + "://" + "l." * 30 + "com/" + "d/" * 40,
    ]
    urls += urls[5:8]
    urls += ["http://x.net/es/" + "d/" * 500_000, "http://" + "l." * 300_000 + "example.com/en/", "http://a.com/" + "/" * 100_000 + "?/"]
    pages = spark.createDataFrame([(k % 7 if k else None, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1))
    got = url_filters.filter_urls(pages, url_filters.rules_frame(spark, RULES)).select("page_id", "url", "__url.*").collect()
    assert multiset(got) == Counter((k % 7 if k else None, u, *brute_url(u)) for k, u in enumerate(urls))
    assert url_filters.filter_urls(pages.limit(0), url_filters.rules_frame(spark, RULES)).count() == 0


# -- 5 ------------------------------------------------------------------------


def test_mixing(docs, rows, empty, monkeypatch):
    first = None
    for bucket in (50_000, 3):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
        got = mixing.plan_mix(docs, ["doc_id", "source"]).select("doc_id", "source", "__mix.*").collect()
        now = multiset((r.doc_id, r.size, r.taken) for r in got)
        assert first in (None, now)
        first = now
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while True:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = Counter()
    for r in got:
        assert r.size == r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(c.words for c in r.copies)
        assert all(0 <= c.position <= 1 for c in r.copies)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sum(target.values()) == pytest.approx(total)
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    words = Counter()
    for r in mix.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert words == Counter({s: n for s, n in taken.items() if n})
    assert mixing.plan_mix(empty, ["doc_id"]).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_positions(spark):
    shares = spark.createDataFrame([(k / 10,) for k in range(11)], "s double")
    for schedule in ((1.5, 0.5), (1.0, 1.0), (0.0, 1.0, 4.0, 1.0)):
        got = [r[0] for r in shares.select(mixing.position_of(F.col("s"), schedule)).collect()]
        grid = np.linspace(0, 1, 200_001)
        rate = np.interp(grid, np.linspace(0, 1, len(schedule)), schedule)
        area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        assert got == pytest.approx(np.interp(np.arange(11) / 10, area / area[-1], grid), abs=1e-3)


# -- 6 ------------------------------------------------------------------------


def test_media(docs, rows, empty):
    want = Counter()
    for i, text, *_ in rows:
        raw = (text or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        want[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    got = media.media_digest(docs).collect()
    assert multiset(r[:5] for r in got) == want
    by_payload = defaultdict(set)
    for r in got:
        by_payload[r.payload_sha256].add(tuple(r)[5:])
    assert all(len(v) == 1 for v in by_payload.values())
    assert media.media_digest(empty).count() == 0


def test_codecs():
    # values of the standard expansion tables
    assert media.TABLES["ulaw"][[0x00, 0x80, 0xFF, 0x7F, 0x8F]].tolist() == [-32124, 32124, 0, 0, 16764]
    assert media.TABLES["alaw"][[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    wave = (8000 * np.sin(np.arange(121 * 6) / 9)).astype(np.int16).reshape(6, 121)
    blocks = media.encode_adpcm(wave)
    back = media.decode_adpcm(blocks)
    assert back.shape == wave.shape and np.abs(back[:, 40:].astype(int) - wave[:, 40:]).max() < 1500
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, (5, 64), dtype=np.uint8)
    for row, whole in zip(media.decode_adpcm(noise), noise):
        predictor, index = int(np.frombuffer(whole[:2].tobytes(), "<i2")[0]), min(int(whole[2]), 88)
        want = [predictor]
        for byte in whole[4:]:
            for nibble in (int(byte) & 15, int(byte) >> 4):
                step = int(media.STEPS[index])
                change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                predictor = max(-32768, min(32767, predictor - change if nibble & 8 else predictor + change))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
                want.append(predictor)
        assert row.tolist() == want
    for name in media.CODECS:
        assert media.parse_wav(media.wav(name, bytes(64)))[0] == name
    with pytest.raises(ValueError):
        media.parse_wav(b"RIFF")
    assert media.resample(np.array([0, 10, 20], np.int16)).tolist() == [0, 5, 10, 15, 20, 20]


# -- 7 ------------------------------------------------------------------------


def test_toxicity(spark, empty):
    rng = random.Random(3)
    calm = [f"w{k}" for k in range(300)]
    rude = ["grunfle", "sporkey", "blatto"]
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(calm) for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            words[3:3] = rng.sample(rude, 2)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "w1 grunfle sporkey"), (1002, "unheard of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held) and len(held) > 80
    truth = dict(labels)
    right = sum(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth)
    assert right >= 0.97 * sum(r.doc_id in truth for r in held)
    assert {r.score for r in got if r.doc_id in (1000, 1001)} == {next(r.score for r in got if r.doc_id == 1000)}
    assert toxicity.score_documents(docs.limit(0), marks).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, marks.limit(0)).collect()} == {0.0}


def test_toxicity_of_repeated_ids(spark, docs):
    """Repeated labelled ids, in any order of rows, give one example each; evidence names documents."""
    texts = ["w1 w2 grunfle w3", "w4 w5 w6 w7", "sporkey w8 grunfle w9", "w2 w4 w6 w8"]
    rows = [(k % 12, texts[k % 4] + f" v{k % 7}", "x") for k in range(60)]
    rows += [rows[5]] * 40 + [(2, None, "x"), (3, "grunfle " * 30_000, "x")]
    marks = spark.createDataFrame([(k, int(k % 2 == 0), "y") for k in range(12)], "doc_id long, toxic int, score string")
    runs = []
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string, score string").repartition(3)
        got = toxicity.score_documents(frame, marks).collect()
        runs.append(multiset((r.doc_id, round(r.score, 9), r.predicted) for r in got))
        named = {int(x.split(":")[0]) for r in got for x in r.evidence.split(",") if x}
        assert named <= {k for k in range(12) if zlib.crc32(str(k).encode()) % 3 != 1}
    assert runs[0] == runs[1] and sum(runs[0].values()) == len(rows)
    clashing = toxicity.score_documents(docs, marks)
    assert clashing.count() == docs.count()


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        f = np.sort(rng.choice(90, rng.integers(0, 25), replace=False))
        w = rng.random(len(f)) + 0.01
        vectors.append((f, w / np.linalg.norm(w) if len(w) else w))
    index = toxicity.Index(vectors, rng.integers(0, 2, 700), 90)
    dense = np.zeros((700, 90))
    for row, i in enumerate(index.order):
        dense[row, vectors[i][0]] = vectors[i][1]
    for k in range(0, 700, 13):
        f, w = vectors[k]
        if len(f):
            scores = dense[:, f] @ w
            _, near = index.nearest(f, w, 12)
            assert near == pytest.approx(np.sort(scores[scores > 0])[::-1][:12])


# -- 8 ------------------------------------------------------------------------


def brute_repeats(rows):
    first = {}
    for i, text, *_ in rows:
        b = (text or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, 2**63), 2**63 - 1 if i is None else i)
    out = Counter()
    for i, text, *_ in rows:
        b = (text or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (2**63 - 1 if i is None else i):
                cover[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1]))
        out[i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block,broadcast", [(8 << 20, 1 << 20), (500, 1 << 20), (2000, 0)])
def test_repeats(docs, rows, empty, monkeypatch, block, broadcast):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "MERGE_BYTES", block)
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", broadcast)
    assert multiset(r[:5] for r in substrings.remove_repeats(docs).collect()) == brute_repeats(rows)
    if block == 500:
        assert substrings.remove_repeats(empty).count() == 0


def test_cover_meets_every_shift():
    cover = set(substrings.COVER)
    assert {(a - b) % substrings.PERIOD for a in cover for b in cover} == set(range(substrings.PERIOD))
    names = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (substrings.unpack(substrings.pack(names)) == names).all()


def test_hostile_strings(spark):
    """Strings whose polynomial hashes modulo 2^64 agree are told apart."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    flipped = word.translate(str.maketrans("ab", "ba"))
    head, tail = "x" * 60, "0123456789" * 3
    rows = [(1, head[:30] + word[:64] + tail), (2, head[:30] + flipped[:64] + tail), (3, word), (4, flipped), (5, tail * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert multiset(r[:5] for r in substrings.remove_repeats(docs).collect()) == brute_repeats(rows)


@pytest.mark.parametrize("top", [3, 200, 2**20, 2**63])
def test_order_of_names(top):
    names = np.random.default_rng(top % 97).integers(0, top, 5000, dtype=np.uint64)
    names = np.concatenate([names, names[:1000] ^ np.uint64(1), names[:7]])
    assert (substrings._order(names) == np.argsort(names, kind="stable")).all()
    assert len(substrings._order(names[:0])) == 0 and substrings._order(names[:1]).tolist() == [0]


def test_names_that_collide():
    """Where two strings share a name, the check tells them apart."""
    rng = np.random.default_rng(3)
    names, checks, ids = rng.integers(1, 4, 60, dtype=np.uint64), rng.integers(5, 8, 60, dtype=np.uint32), np.sort(rng.integers(0, 9, 60))
    got, low, high, place, own = substrings._distinct(names, ids, checks)
    both = list(zip(names.tolist(), checks.tolist()))
    assert list(zip(got.tolist(), own.tolist())) == sorted(set(both))
    for k, key in enumerate(both):
        of = [i for i, other in zip(ids.tolist(), both) if other == key]
        assert (got[place[k]], own[place[k]], low[place[k]], high[place[k]]) == (*key, min(of), max(of))
    lists = [sorted(set(both[k::4])) for k in range(4)]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([0] * 4, pa.int32()), pa.array(range(4), pa.int64()),
            pa.array([substrings.pack(np.array([n for n, _ in x], np.uint64)) for x in lists], pa.binary()),
            pa.array([np.array([c for _, c in x], "<u4").tobytes() for x in lists], pa.binary()),
        ],
        names=["range", "block", "names", "checks"],
    )
    (out,) = substrings._merge(earlier_only=True)([batch])
    for k, (n, bits) in enumerate(zip(out.column("n").to_pylist(), out.column("bits").to_pylist())):
        found = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool).tolist()
        assert found == [any(x in earlier for earlier in lists[:k]) for x in lists[k]]


# -- 9 ------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    counts = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(seen) - len(set(seen)), len(covered)
    return *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def test_quality(docs, rows, empty):
    got = quality.judge(docs, ["doc_id"]).select("doc_id", "__quality.*").collect()
    assert multiset(r[:7] for r in got) == Counter((r[0], *brute_quality(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert not any(r.kept for r in got if r.doc_id in (38, 39))
    assert quality.judge(empty, ["doc_id"]).count() == 0 and quality.keep_good(empty).count() == 0


# -- 10 -----------------------------------------------------------------------


@pytest.mark.parametrize("shard", [1 << 22, 500])
def test_token_files(spark, docs, rows, empty, monkeypatch, shard):
    monkeypatch.setattr(tokenfile, "SHARD_TOKENS", shard)
    library = tokenizers.Tokenizer.from_file(WORDS)
    ids = [(r[0], np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")) for r in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(map(tuple, tokenfile.digest(docs, WORDS, 2).collect()), key=lambda r: r[1])
    assert multiset((d, n, c) for d, _, n, c in got) == Counter((d, len(i), zlib.crc32(i.tobytes())) for d, i in ids)
    assert [d for d, *_ in got] == [d for d, _ in ids]
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    if shard == 500:
        assert tokenfile.digest(empty, WORDS, 2).count() == 0


def test_word_cache_matches_library():
    rng = random.Random(2)
    own = tokenfile.coder(WORDS)
    assert own.by_word
    alphabet = "aBcÉé日 \t\n  'sS1²Ⅷ<|>.,$́ßİŉ\x1c\x85_~\x7fſǅΣ"
    texts = ["", "<|endoftext|>x a<|startoftext|>b", "don't we'LL I'M"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(2000)]
    for text, raw in zip(texts, own.encode(texts)):
        assert np.frombuffer(raw, own.kind).tolist() == own.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 5, 2047, 2048, 2049, 9000])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49407).astype(np.uint32)
    table = tokenfile.Table(*np.unique(ids, return_counts=True))
    assert int(table.freq.sum()) == 1 << tokenfile.SCALE
    block = tokenfile.encode_block(ids, table)
    assert (tokenfile.decode_block(block, n, table) == ids).all()
    file = tokenfile.pack_shard([1, None], [n - 1, 1], ids, table)
    docs, counts, back = tokenfile.unpack_shard(file, table)
    assert docs == [1, None] and counts.tolist() == [n - 1, 1] and (back == ids).all()
    broken = bytearray(file)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        tokenfile.unpack_shard(bytes(broken), table)
