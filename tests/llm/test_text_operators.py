"""Operators on documents against brute force, on rows with everything that can be odd about them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanspan.llm import binary, mixing, packing, quality, sharding, simhash, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join(rng.choice("the of and to in is on for that it house tree river stone light green walks under".split()) for _ in range(n))


def ids_of(text, end):
    return np.array(tokens.encoder(tokens.default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


# --- op 1 --------------------------------------------------------------------------------------------


def base(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated), failed


def test_quality_counts(odd, odd_rows, none):
    got = quality.assess(odd).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter((r[0], *base(r[1])) for r in odd_rows)
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed) and any(r.kept for r in got)
    assert quality.assess(none).count() == 0


def test_js_distance(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.25, 0.75], [0.5, 0.5]), (None, [1.0, 0.0])], "p array<double>, q array<double>")
    got = [r.d for r in df.coalesce(1).select(quality.js_distance(F.col("p"), F.col("q")).alias("d")).collect()]
    p, q = np.array([0.25, 0.75]), np.array([0.5, 0.5])
    m = (p + q) / 2
    want = np.sqrt((np.sum(p * np.log2(p / m)) + np.sum(q * np.log2(q / m))) / 2)
    assert got[0] == 0 and got[1] == pytest.approx(1) and got[2] == pytest.approx(want) and got[3] is None


def test_quality_rejects_what_diverges(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, 150), "en", "s", 1) for i in range(60)]
    junk = " ".join(f"@@{i}^^~~{i}" + "#" * 9 + "%%" for i in range(80))
    df = spark.createDataFrame([*rows, (99, junk, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert 99 not in kept and len(kept) == 60


def test_quality_references_withstand_junk(spark):
    """A third of a language is junk that passes the base rules, with many copies; the clean texts stay, the junk goes."""
    rng = random.Random(2)

    def numbers():
        return " ".join(str(rng.randint(1000, 99_999_999)) for _ in range(120))

    clean = [(i, sentence(rng, 150), "en", "s", 1) for i in range(80)]
    junk = [(100 + i, numbers(), "en", "s", 1) for i in range(40)]
    copies = [(200 + i, junk[0][1], "en", "s", 1) for i in range(200)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([*clean, *junk, *copies], columns).repartition(3)
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == list(range(80))
    assert sorted(r.doc_id for r in quality.assess(df).where("kept").collect()) == list(range(80))
    # A language of few texts, most of them junk, is held against the fixed references.
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'fr'").select("doc_id", "text", "lang", "source", "n_chars")
    sound = quality.assess(rows).where("kept").orderBy("doc_id").limit(5).select("doc_id")
    few = rows.join(sound, "doc_id").unionByName(spark.createDataFrame([(-i, numbers(), "fr", "s", 1) for i in range(1, 10)], columns))
    kept = {r.doc_id for r in quality.keep_good(few).collect()}
    assert len(kept) == 5 and min(kept) >= 0


# --- op 2 --------------------------------------------------------------------------------------------


def test_packing(odd, odd_rows, none):
    got = packing.pack(odd).collect()
    texts = defaultdict(list)
    for r in odd_rows:
        texts[r[0]].append(ids_of(r[1], packing.END_ID))
    pieces = defaultdict(Counter)
    for r in got:
        pieces[r.doc_id][(r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
    want = defaultdict(Counter)
    for doc, copies in texts.items():
        for ids in copies:
            for start, n in packing.cuts(len(ids)):
                want[doc][(start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids))] += 1
    assert pieces == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(r.length for r in got)
    assert len(sequences) == -(-total // packing.CAPACITY)
    assert packing.pack(none).count() == 0


def test_plan_covers_demand():
    rng = np.random.default_rng(3)
    for n in (3, 400):
        counts = Counter(p[1] for x in rng.lognormal(5, 1.5, n).astype(int) + 1 for p in packing.cuts(int(x)))
        places = defaultdict(list)
        load = Counter()
        for length, first, many, sequence, each, offset in packing.plan(dict(counts)):
            places[length].append((first, many))
            for k in range(many):
                load[sequence + k // each] += length
        for length, spans in places.items():
            at = 0
            for first, many in sorted(spans):
                assert first == at
                at += many
            assert at == counts[length]
        assert max(load.values()) <= 4096 and len(load) <= -(-sum(load.values()) // 4096) + 2
    assert packing.plan({}) == []


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths, prices = rng.integers(1, 12, 4), rng.random(4)
        value, pattern = packing.best_pattern(lengths, prices, 23)
        best = max(
            a * prices[0] + b * prices[1] + c * prices[2] + d * prices[3]
            for a in range(24) for b in range(24) for c in range(24) for d in range(24)
            if a * lengths[0] + b * lengths[1] + c * lengths[2] + d * lengths[3] <= 23
        ) if lengths.min() > 3 else value
        assert value == pytest.approx(best) and pattern @ lengths <= 23 and pattern @ prices == pytest.approx(value)


def test_encoder_equals_library(odd_rows):
    e = tokens.encoder(tokens.default_tokenizer())
    rng = np.random.default_rng(1)
    letters = list("ab Z'stré́ \x1c\x85\x0b\x0c\n\t ΣςİIK1٢３#*'ll‍\U0001f600ß가　 .,;:!?<>")
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)] + [r[1] or "" for r in odd_rows]
    for text in texts:
        assert list(np.frombuffer(e.encode(text), "<u4")) == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_columns_are_encoded_as_their_texts(odd_rows):
    import pyarrow as pa

    e = tokens.WordEncoder(tokens.default_tokenizer(), limit=50)
    rng = np.random.default_rng(2)
    letters = list("ab Z'HJT\u0331\u030c\u0308stré́ \x1c\x85\x0b\x0c\n\t\0 ΣςİIK1٢３#*'ll\u200d\U0001f600ß가\u00a0　\u2028 .,;:!?<>|")
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)] + [r[1] for r in odd_rows]
    texts += ["<|ENDOFTEXT|> <|endoftext|> a<|endoftext|>.", "abc<|startoftext|>", "Don't. DON'T!", "THE\tthe. The, ...", "a" * 70_000, "x.\n", "é.\n"]
    texts += [f"{chr(c)}A. B{chr(c)} {chr(c)}" for c in range(0x80, 0x250)]  # every letter that a column has in plain words, and others
    want = [np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string()), pa.array(["x y", None, *texts], pa.string()).slice(2)):
        for most in (1, 1000, 1 << 30):
            got = [(ids.tobytes(), 4 * counts) for ids, counts in e.encode_column(column, most)]
            cut = [ids[end - n : end] for ids, sizes in got for end, n in zip(np.cumsum(sizes), sizes, strict=True)]
            assert cut == want and all(len(ids) == sum(sizes) for ids, sizes in got)
    for ends in (e.ends | True, None):  # words that the model does not end as expected are encoded one by one
        e = tokens.WordEncoder(tokens.default_tokenizer())
        e.ends = ends
        assert b"".join(ids.tobytes() for ids, _ in e.encode_column(column)) == b"".join(want)
    for none in ([], [None, None], ["", " \n"]):
        assert [(len(ids), counts.tolist()) for ids, counts in e.encode_column(pa.array(none, pa.string()))] == [(0, [0, 0])] * bool(none)


def test_a_column_looks_up_each_word_once():
    import pyarrow as pa

    looked = Counter()

    class Counted(tokens.Words):
        def get(self, word):
            looked[word] += 1
            return super().get(word)

    e = tokens.WordEncoder(tokens.default_tokenizer())
    e.words = Counted(e.learn, tokens.CACHE_WORDS)
    assert sum(counts.sum() for _, counts in e.encode_column(pa.array(["in the house", "The house.  in", "House"] * 1000))) == 8000
    assert looked == {w: 1 for w in (b"in", b"the", b"house", b".", b"")}


# --- op 3 --------------------------------------------------------------------------------------------


def test_sharding(spark, odd, odd_rows, none, tmp_path):
    folder = str(tmp_path / "map")
    got = sharding.shard(odd, folder=folder).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(16))
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    rest = sorted((r["size"] for r in got), reverse=True)[2:]  # two texts are larger than an even share
    assert max(load.values()) <= max(r["size"] for r in got) + max(rest) and min(load.values()) > 0
    first, second = (dict(sharding.load_map(spark, folder, v).collect()) for v in (0, 1))
    assert len(first) == len(second) == sharding.SLOTS and first[17] == 1
    assert sharding.shard(none).count() == 0


def test_rebalancing():
    rng = np.random.default_rng(2)
    sizes = {i: int(x) for i, x in enumerate(rng.lognormal(8, 1, 4096))}
    old = sharding.first_map()
    new = sharding.rebalanced(old, sizes)
    load = Counter()
    for slot, b in sizes.items():
        load[new[slot]] += b
    assert max(load.values()) - min(load.values()) <= 0.001 * sum(load.values())
    moved_slots = sum(a != b for a, b in zip(old, new, strict=True))
    assert 0 < moved_slots < 400 and sharding.rebalanced(new, sizes) == new and sharding.rebalanced(old, {}) == old
    more = sharding.grown(new, sizes, 16)
    assert all(a == b or b == 16 for a, b in zip(new, more, strict=True))
    moved = sum(sizes[i] for i, s in enumerate(more) if s == 16)
    assert moved == pytest.approx(sum(sizes.values()) / 17, rel=0.05)


# --- op 4 --------------------------------------------------------------------------------------------


def water_filled(sizes):
    """Targets by the rule itself: excess is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free, target, left = set(order), {}, 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def reversed_bits(i):
    return int(f"{i:048b}"[::-1], 2) / 2**48


def brute_mix(rows, block, point):
    """(doc_id, size, taken, first slot) of each row and the positions of all copies, by drawing slot after slot."""
    sizes, lines = Counter(), defaultdict(list)
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] += n
        key = hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()
        lines[r[3]].append((key, -1 if r[0] is None else r[0], n, r[0]))
    target = water_filled(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    words = sum(target.values())
    drawn = defaultdict(list)
    for slot in range(-int(-words // block)):
        at, x = 0.0, point(slot)
        for s in order:
            at += target[s]
            if x < at / words:
                drawn[s].append(slot)
                break
    out, copies = Counter(), []
    for s, line in lines.items():
        given, at = min(len(drawn[s]) * block, 2 * sizes[s]), 0
        for _, _, n, doc in sorted(line):
            parts = [max(0, min(n, given - r * sizes[s] - at)) for r in (0, 1)]
            out[(doc, n, sum(parts), drawn[s][at // block] if sum(parts) else None)] += 1
            for r, part in enumerate(parts):
                if n and 2 * part >= n:
                    begin = r * sizes[s] + at
                    copies.append((drawn[s][begin // block] * block + begin % block, doc))
            at += n
    return out, [doc for _, doc in sorted(copies)], target


def golden(i):
    return F.pmod(i * F.lit(0.6180339887498949), F.lit(1.0))


@pytest.mark.parametrize("block, sequence, point", [(7, mixing.van_der_corput, reversed_bits), (640, mixing.van_der_corput, reversed_bits), (97, golden, lambda i: i * 0.6180339887498949 % 1)])
def test_mixing(odd, odd_rows, none, block, sequence, point):
    want, order, target = brute_mix(odd_rows, block, point)
    got = mixing.planned(odd, block=block, sequence=sequence).collect()
    assert Counter((r.doc_id, r["size"], r.taken, r.first_slot) for r in got) == want
    taken = Counter()
    for r in got:
        source = None if r.src.absent else r.src.name
        taken[source] += r.taken
        assert r.target == pytest.approx(target[source]) and r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 12 * block for s in target)
    mixed = mixing.mix(odd, block=block, sequence=sequence)
    assert [r.doc_id for r in mixed.collect()] == order and mixed.columns == odd.columns
    assert len(set(order)) < len(order)
    again = mixing.planned(odd.repartition(5), block=block, sequence=sequence).collect()
    assert Counter((r.dice, r.start, r.taken, r.first_slot) for r in again) == Counter((r.dice, r.start, r.taken, r.first_slot) for r in got)
    assert mixing.planned(none).count() == 0 and mixing.mix(none).count() == 0


def test_the_points_decide_the_mix(odd):
    """Another sequence gives another mix: other amounts, other places."""
    amounts, orders = [], []
    for sequence in (mixing.van_der_corput, golden, lambda i: i * 0.0):
        amounts.append({(r.dice, r.start): r.taken for r in mixing.planned(odd, block=640, sequence=sequence).collect()})
        orders.append([r.doc_id for r in mixing.mix(odd, block=640, sequence=sequence).collect()])
    assert amounts[0] != amounts[2] and orders[0] != orders[1] and len(set(orders[2])) < len(set(orders[0]))


def test_van_der_corput(spark):
    got = [r.x for r in spark.range(8).coalesce(1).select(mixing.van_der_corput(F.col("id")).alias("x")).collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]


# --- op 6 --------------------------------------------------------------------------------------------


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(0)
    plain = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = list(rng.choice(plain, 40))
        if toxic:
            words[::9] = [["moron,", "zorkling", "zorkled", "Pathetic"][i // 6 % 4]] * len(words[::9])
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 2 == 0:
            marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, "word1", None, None, 1), (5000, None, None, None, 1), (5001, "", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.predictions(docs, labels).collect()}
    assert len(got) == 903
    for i in range(900):
        assert got[i].predicted == int(i % 6 == 0), rows[i]
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
    assert got[5000].score == got[5001].score < 0.5
    # Held-out labels have no part in the model.
    flipped = spark.createDataFrame([(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in marks], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in toxicity.predictions(docs, flipped).collect()} == {d: r.score for d, r in got.items()}
    # Without labels the fixed lexicons decide, and nothing fails on odd rows.
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.predictions(odd, empty).count() == odd.count() and toxicity.predictions(none, empty).count() == 0
    assert toxicity.keep_clean(odd, empty).columns == odd.columns


def test_label_model_discounts_copies():
    rng = np.random.default_rng(1)
    gold = rng.integers(0, 2, 4000)
    strong = ((rng.random(4000) < 0.9) & (gold == 1)).astype(float)
    weak = (rng.random(4000) < np.where(gold == 1, 0.4, 0.2)).astype(float)
    fired = np.stack([strong, weak, weak, weak, weak], axis=1)
    posterior, rate, say = toxicity.label_model(fired, gold)
    assert say[0] > 0.8 and say[1] == pytest.approx(0.25, abs=0.05)
    assert rate[1, 0] == pytest.approx(0.9, abs=0.05) and ((posterior > 0.5) == gold).mean() > 0.9


# --- op 9 --------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {f: find(f) for f in fps}


def test_near_duplicates(odd, odd_rows, none):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect())
    short = {r[1]: brute_fingerprint(r[1]) for r in odd_rows}
    root = brute_components(short.values())
    least = {}
    for r in odd_rows:
        if r[0] is not None:
            k = root[short[r[1]]]
            least[k] = min(least.get(k, r[0]), r[0])
    assert got == Counter((r[0], f"{short[r[1]]:016x}", least.get(root[short[r[1]]])) for r in odd_rows)
    kept = simhash.keep_one(odd)
    assert kept.count() == len(set(root.values())) and kept.columns == odd.columns
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("cell", [simhash.CELL, 15])
def test_links_of_dense_groups(spark, cell):
    """Chains and dense groups of fingerprints, with cells that are cut into blocks and cells that are not."""
    rng = np.random.default_rng(7)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    for centre in fps[:3]:
        fps += [centre ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 3))) for _ in range(120)]
    chain = fps[3]
    for _ in range(15):
        chain ^= sum(1 << int(b) for b in set(rng.integers(0, 64, 4)))
        fps.append(chain)
    want = brute_components(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in want], "fp long").repartition(3)
    got = {f: f for f in want} | {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(simhash.grid_links(df, cell_size=cell)).collect()}
    groups = [defaultdict(set), defaultdict(set)]
    for f in want:
        groups[0][want[f]].add(f)
        groups[1][got[f]].add(f)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


def test_images_bound_distances():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 2**63, (2, 4000)).astype(np.uint64)
    b = np.where(rng.random(4000) < 0.5, a ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)), b)
    count = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * i)) & np.uint64(3)).astype(int) for i in range(32)])
    want = np.abs(count(a) - count(b)).sum(axis=0)
    assert (simhash.manhattan(a, b) == want).all() and (want <= simhash.hamming(a, b)).all()
    close = simhash.hamming(a, b) <= 4
    assert (simhash.cells_of(a[close]) == simhash.cells_of(b[close])).any(axis=1).all()


# --- op 10 -------------------------------------------------------------------------------------------


def test_token_files(odd, odd_rows, none, tmp_path):
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in binary.round_trip(odd, folder=f"file://{tmp_path}/t", block_ids=9000, split_blocks=2).collect()))
    at, last = 0, None
    for start, doc, n, _ in got:
        assert start == at and (last is None or doc >= last)
        at, last = at + n, doc
    want = Counter((r[0], len(ids), zlib.crc32(ids.tobytes())) for r in odd_rows if len(ids := ids_of(r[1], binary.END_ID)))
    assert Counter((d, n, c) for _, d, n, c in got) == want
    assert binary.round_trip(none).count() == 0


def test_coder_round_trips():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 127, 129, 700, 5000):
        for ids in (rng.integers(0, 65536, n), rng.integers(0, 2, n), np.zeros(n), rng.zipf(1.4, n) % 49408, np.arange(n) % 7):
            ids = ids.astype(np.uint32) % 65536
            assert (binary.decode_ids(binary.encode_ids(ids), n) == ids).all()
    assert len(binary.encode_ids(np.arange(70_000) % 50)) < 10_000


def test_damage_is_found(tmp_path):
    from io import BytesIO

    ids = np.arange(300) % 40
    block = binary.write_block([7, None], [100, 200], ids)
    good = list(binary.read_blocks(BytesIO(binary.MAGIC + block + block)))
    assert len(good) == 2 and good[0][0] == [7, None] and good[1][1] == [100, 200] and (good[0][2] == ids).all()
    for at in (40, len(block) - 3):
        bad = bytearray(binary.MAGIC + block)
        bad[at] ^= 1
        with pytest.raises(binary.DamagedBlock):
            list(binary.read_blocks(BytesIO(bytes(bad))))
    with pytest.raises(binary.DamagedBlock):
        list(binary.read_blocks(BytesIO(hashlib.sha1(b"x").digest())))
