"""Each operator against a brute-force version on small tables, and on nulls, empties, ties, repeats and clashing names."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sphera.llm import components, html_text, jaccard_join, kernels, langid, matroska, mixing, passages, pieces, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ka ro mi ten sul vor lin dra pe os".split() for b in "un cha bel tir mo na fe gra wi zu".split()]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


def edited(text: str, seed: int, n: int) -> str:
    r = random.Random(seed)
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = "zz" + w[i]
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    base, passage = prose(1, 120), prose(2, 70)
    texts = [base, base, edited(base, 3, 2), prose(4, 30) + " " + passage + " " + prose(5, 40), prose(6, 55) + " " + edited(passage, 7, 3) + " " + prose(8, 9)]
    texts += [edited(base, 100 + i, 1) for i in range(8)]  # each near the base, not near each other
    texts += [None, "", "  \n\t ", "one", "one two", "ab" * 400, "é日🙂 " * 90, prose(9, 3000), "a" * 650, prose(10, 8)]
    out = [(i, t, "en" if i % 2 else None, f"src{0 if i % 3 else i % 5}", 0) for i, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((None, base, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    return docs.withColumns({c: F.lit(7) for c in ("rid", "spans", "key", "phases", "tox_score", "component", "x", "y")})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


# --- 1 ------------------------------------------------------------------------------------------


def test_simhash_next_and_edit(docs, spark, rows):
    got = simhash.with_next(docs.select("doc_id", "text")).collect()
    order = sorted(((-(1 << 63) if r[0] is None else r[0]), r[1] or "") for r in rows)
    order = sorted(order, key=lambda t: (-t[0], t[1]))
    after = collections.Counter((k, t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))
    assert collections.Counter(((-(1 << 63) if r.doc_id is None else r.doc_id), r.text, r.next_text) for r in got) == after
    assert simhash.with_next(empty(spark)).count() == 0


def test_simhash_votes(spark):
    df = spark.createDataFrame([(1, "a b c d e f a b c d e"), (2, "x y"), (3, ""), (4, None), (5, "a b c d e f a b c d e")], "id long, text string")
    found = simhash.terms(df, "text", "t").select("id", F.explode_outer("t").alias("t"))
    votes = collections.defaultdict(list)
    for r in found.collect():
        votes[r.id].append(r.t)
    got = {r.id: r.fingerprint for r in simhash.vote(found, ["id"], "t").collect()}
    for k, hashes in votes.items():
        hashes = [h & (2**64 - 1) for h in hashes if h is not None]
        want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
        assert (got[k] or 0) & (2**64 - 1) == want
    assert got[1] == got[5] and not got[3] and not got[4]


def test_simhash_near_finds_every_pair(spark):
    r = random.Random(5)
    values = [r.getrandbits(64) for _ in range(40)]
    for v in values[:20]:
        for n in (1, 2, 3, 4):
            w = v
            for b in r.sample(range(64), n):
                w ^= 1 << b
            values.append(w)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = [(x.a, x.b) for x in simhash.near(spark.createDataFrame([(v,) for v in [*signed, signed[0], None]], "fingerprint long")).collect()]
    want = {(a, b) for a in set(signed) for b in set(signed) if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert len(got) == len(set(got)) and set(got) == want


# --- 2 ------------------------------------------------------------------------------------------


def removed(rows, length):
    count = collections.Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = collections.Counter()
    for k, t, *_ in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans = sum(1 for j, c in enumerate(covered) if c and not (j and covered[j - 1]))
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out[(k, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_suffix_dedup(docs, rows, spark):
    got = collections.Counter(tuple(r) for r in suffix_dedup.remove(docs).collect())
    assert got == removed(rows, 200)
    assert suffix_dedup.remove(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_equal_suffixes(seed):
    r = np.random.default_rng(seed)
    text = r.integers(97, 99 + seed, 3000).astype(np.uint8)
    text[1000:1300] = text[200:500]
    text[2000:2200] = 97
    at = np.arange(2700)
    got = suffix_dedup.equal_suffixes(np.r_[text, np.zeros(300, np.uint8)], at, at % 2, 60 + seed)
    keys = [(i % 2, text[i : i + 60 + seed].tobytes()) for i in at]
    count = collections.Counter(keys)
    assert got.tolist() == [count[k] > 1 for k in keys]


# --- 3 ------------------------------------------------------------------------------------------


def test_mixing_keeps_within_one_block(spark):
    rows = [(i, s) for s, n in (("a", 700), ("b", 250), ("c", 41), (None, 9)) for i in range(n)]
    df = spark.createDataFrame([(k, i, s) for k, (i, s) in enumerate(rows)], "doc_id long, key int, source string")
    got = mixing.mix(df, {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}, block_docs=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    slots = collections.defaultdict(set)
    for r in got:
        slots[r["__mix_slot"]].add((r.source, r["__mix_block"]))
        assert r["__mix_release"] <= r["__mix_slot"] < r["__mix_deadline"]
    assert sorted(slots) == list(range(sum(-(-n // 4) for n in (700, 250, 41, 9)))) and all(len(s) == 1 for s in slots.values())
    blocks = {"=a": 175, "=b": 63, "=c": 11, "null": 3}
    plan = mixing.phases(blocks, mixing.shares(blocks, {"=a": 0.5, "=b": 0.3, "=c": 0.15, "null": 0.05}))
    done = collections.Counter()
    order = [next(iter(slots[t]))[0] for t in sorted(slots)]
    for p in plan:
        base = dict(done)
        for t in range(p["start"], p["start"] + p["width"] * p["cycles"]):
            done["null" if order[t] is None else f"={order[t]}"] += 1
            for name, w in zip(p["names"], p["share"], strict=True):
                assert abs(done[name] - base.get(name, 0) - (t + 1 - p["start"]) * w / p["width"]) < 1
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0


# --- 4 ------------------------------------------------------------------------------------------


def test_html_pages_held_out(spark):
    model = html_text.train()
    right = total = 0
    for found, labels in html_text.labelled(200, seed=77):
        got = html_text.decode(model, found)
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98
    page = "<html><head><title>t</title><script>var a='</p><p>no</p>'</script></head><body><nav><a href=/>Home</a></nav><article><h1>A  &amp;\n b</h1><p>One <b>bold</b> text.<p>Two&nbsp;&lt;x&gt;.</article><footer>&copy; me</footer>"
    assert html_text.extract(model, page) == "A & b\nOne bold text.\nTwo <x>."
    df = spark.createDataFrame([(1, page, "u"), (2, None, None), (3, "", "u"), (3, "", "u"), (4, "<<<p <", "u")], "page_id long, html string, url string")
    got = {r.page_id: r.text for r in html_text.text_of(df, model).collect()}
    assert got[1].startswith("A & b") and got[2] == got[3] == ""


def test_viterbi_is_best():
    model = html_text.train(60)
    for found, _ in html_text.labelled(10, seed=5):
        found = found[:9]
        score = lambda path: sum(model.weights.get(f, (0, 0))[s] for b, s in zip(found, path, strict=True) for f in b.features) + model.start[path[0]] + sum(model.step[a][b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max((score([m >> i & 1 for i in range(len(found))]) for m in range(1 << len(found))))
        assert math.isclose(score([int(x) for x in html_text.decode(model, found)]), best)


# --- 5 ------------------------------------------------------------------------------------------


def linked(rows, k, num, den):
    sets = []
    for r in rows:
        w = words_of(r[1])
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sets, group


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, rows, spark, k, num):
    got = jaccard_join.join(jaccard_join.keyed(docs), k, num, 100).collect()
    sets, group = linked(rows, k, num, 100)
    want = collections.Counter()
    for g in set(group):
        members = [i for i in range(len(rows)) if group[i] == g]
        want[tuple(sorted((str(rows[i][0]), len(sets[i])) for i in members))] += 1
    parts = collections.defaultdict(list)
    for n, r in enumerate(got):
        parts[r.component if r.component is not None else f"alone{n}"].append((str(r.doc_id), r.n))
    assert collections.Counter(tuple(sorted(p)) for p in parts.values()) == want
    assert jaccard_join.join(jaccard_join.keyed(empty(spark)), k, num, 100).count() == 0


def test_jaccard_stage_keeps_one(docs, rows, spark):
    kept = jaccard_join.keep_one(spark, clashing(docs), "")
    assert kept.columns == clashing(docs).columns and kept.where("rid <> 7").count() == 0
    sets, group = linked(rows, 5, 80, 100)
    assert kept.count() == len({g for g, s in zip(group, sets, strict=True) if s}) + sum(not s for s in sets)
    assert kept.where("doc_id = 0").count() == 1 and kept.where("doc_id = 1").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 203), (203, 201)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[201] == got[203] == 200


# --- 6 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("lacing", [1, 2, 3])
@pytest.mark.parametrize("size", [0, 1, 576, 577, 576 * 9, 576 * 65 + 1, 90_000])
def test_media_round_trip(size, lacing):
    payload = matroska.padded(os.urandom(size))
    data = matroska.mux(payload, lacing)
    found = matroska.parse(data)
    assert found.ok and b"".join(data[p.offset : p.offset + p.size] for p in found.packets) == payload
    assert {c for _, _, c in found.cues} == {p.cluster for p in found.packets}
    assert not matroska.parse(data[:-3]).ok


def test_media_numbers():
    assert matroska.vint(b"\x81", 0) == (1, 1) and matroska.vint(b"\x40\x02", 0) == (2, 2) and matroska.vint(b"\xff", 0) == (-1, 1)
    for n in (0, 126, 127, 128, 2**21, 2**40):
        assert matroska.vint(matroska.put_vint(n), 0)[0] == n
    assert matroska.parse(None).packets == [] and not matroska.parse(b"\0").ok


def test_media_digests(docs, rows, spark):
    got = {r.doc_id: r for r in matroska.digests(matroska.store(docs)).collect()}
    for k, t, *_ in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 or 576 * (not b))
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    packets = matroska.packets(matroska.store(docs)).groupBy("doc_id").agg(F.sum("size").alias("n")).collect()
    assert {r.doc_id for r in packets} == set(got)
    assert matroska.digests(matroska.store(empty(spark))).count() == 0


# --- 7 and 8 ------------------------------------------------------------------------------------


def test_langid_held_out():
    r = random.Random(3)
    tongue = {"aa": "the of and ing er".split(), "bb": "der ung sch ein üb".split(), "cc": "que ción ar ñ el".split()}
    make = lambda lang: " ".join("".join(r.choices(tongue[lang], k=r.randint(1, 3))) for _ in range(40))
    labels = [r.choice(sorted(tongue)) for _ in range(300)]
    texts = [make(x) for x in labels]
    df = sum((langid.counts(part)[0] > 0).sum(0) for _, part in langid._blocks(texts[:200]))
    model = langid.fit(texts[:200], labels[:200], (np.log(201 / (1 + df)) + 1).astype(np.float32))
    got, score = langid.predict(model, texts[200:])
    assert np.mean([a == b for a, b in zip(got, labels[200:], strict=True)]) > 0.97 and score.min() >= 0 and score.max() <= 1
    assert langid.predict(model, [None, "", "12 !?", "日本"])[0][:3] == ["und"] * 3
    assert langid.predict(langid.fit([], [], np.ones(langid.BUCKETS, np.float32)), ["x"])[0] == ["und"]


def test_toxicity_learns_and_reads_misspellings():
    r = random.Random(4)
    bad = ["gruzzlepated", "snorkwitch", "flubbermaw"]

    def make(toxic):
        w = r.choices(WORDS, k=r.randint(30, 200))
        for i in range(0, len(w), 12) if toxic else ():
            w[i] = r.choice(bad)
        return " ".join(w)

    labels = np.array([i % 4 == 0 for i in range(400)], int)
    texts = [make(x) for x in labels]
    flat = lambda ts: kernels.text_bytes(pa.array(ts, "string"))
    model = toxicity.fit(toxicity.gathered([toxicity.words_of(*flat(part)) for part in (texts[:120], texts[120:300])]), labels[:300])
    ask = lambda ts: toxicity.score_slice(model, *flat(ts))
    got = ask(texts[300:]) >= 0.7
    assert np.mean(got == labels[300:]) > 0.95
    odd = ask([" ".join(r.choices(WORDS, k=20) + ["gruzzlepatedd", "snorkwich", "flubermaw"] * 2), make(False)])
    assert odd[0] > odd[1]
    assert np.allclose(ask([None, "", " "]), ask([""])[0])


# --- 9 ------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")
def test_pieces_equal_the_library(docs, rows, spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encode(docs)
    for r in got.collect():
        assert r.ids == library.encode(r.text or "") and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = pieces.decode(got.drop("text")).select("doc_id", "text").collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((r[0], r[1] or "") for r in rows)
    assert pieces.encode(empty(spark)).count() == 0


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")
def test_pieces_random_texts():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(9)
    texts = ["".join(r.choice(["the", "an", " ", "  ", "\n", "é", "日", "b1.", "▁", "\0", "🙂", "tion"]) for _ in range(r.randint(0, 90))) for _ in range(300)]
    coder = pieces.Encoder(pieces.Vocabulary.load())
    flat, offsets = coder.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library.encode(t) for t in texts]


# --- 10 -----------------------------------------------------------------------------------------


def test_fenwick_ranges():
    r = random.Random(3)
    tree, plain = passages.Fenwick(40), [passages._NOTHING] * 41
    for _ in range(2000):
        at, value = r.randint(1, 40), r.choice([passages._NOTHING, (r.random(), 1)])
        tree.set(at, value)
        plain[at] = value
        low = r.randint(1, 40)
        high = r.randint(low - 1, 40)
        assert tree.largest(low, high) == max(plain[low : high + 1], default=passages._NOTHING)


def test_chain_is_best():
    r = random.Random(11)
    for _ in range(30):
        n = r.randint(2, 60)
        px, py = np.array([r.randint(0, 120) for _ in range(n)]), np.array([r.randint(0, 120) for _ in range(n)])
        order = sorted(range(n), key=lambda i: (px[i], py[i]))
        best = {}
        for i in order:
            best[i] = passages.K
            for j in best:
                if px[j] < px[i] and py[j] < py[i] and px[i] - px[j] <= passages.MAX_GAP + passages.K and py[i] - py[j] <= passages.MAX_GAP + passages.K:
                    value = best[j] + min(passages.K, px[i] - px[j], py[i] - py[j]) - passages.GAP_COST * (px[i] - px[j] + py[i] - py[j])
                    best[i] = max(best[i], value)
        path = passages.chain(px, py)[0]
        score = passages.K + sum(min(passages.K, px[b] - px[a], py[b] - py[a]) - passages.GAP_COST * (px[b] - px[a] + py[b] - py[a]) for a, b in zip(path, path[1:], strict=False))
        assert (np.diff(px[path]) > 0).all() and (np.diff(py[path]) > 0).all()
        assert math.isclose(score, max(best.values()))


def test_passages_found_and_removed(docs, spark, rows):
    left = {}
    for r in passages.remove(clashing(docs)).collect():
        left.setdefault(r.doc_id, []).append(r.text)
        assert r.rid == r.spans == 7
    assert len(left[3]) == 2 and sum(len(t) for t in left[3]) < 2 * len(rows[3][1])
    assert sum(len(t) for k in (0, 1, 2, None) for t in left[k]) <= len(rows[0][1]) + 60  # of the copies one stays
    assert left[13] == [None] and left[14] == [""] and left[20] == [rows[20][1]] and left[16] == ["one"]
    passage, fuzzy = set(words_of(rows[3][1])[32:98]), [t for t in left[4]][0]
    assert len(words_of(fuzzy)) < 80 or len(passage & set(words_of(left[3][0]))) < 40
    assert passages.remove(empty(spark)).count() == 0


def test_passages_of_one_pair_far_apart(spark):
    first, second = prose(40, 150), prose(41, 150)
    x = f"{first} {prose(42, 60)} {second}"
    df = spark.createDataFrame([(0, f"{first} {second}"), (1, x)], "rid long, text string").coalesce(1)
    found = [(r.x_from, r.x_to) for r in passages.passages(df).collect()]
    assert {w for a, b in found for w in range(a, b)} >= set(range(150)) | set(range(210, 360))
    px = np.r_[np.arange(0, 100, 4), np.arange(200, 300, 4)]
    py = np.r_[np.arange(0, 100, 4), np.arange(100, 200, 4)]
    assert sorted(len(path) for path in passages.chain(px, py)) == [25, 25]


def test_passages_beside_a_stray_match(spark):
    first, second, phrase = prose(50, 30), prose(51, 30), prose(52, 14)
    y = f"{prose(53, 20)} {phrase} {prose(54, 40)} {first} {second} {prose(55, 20)}"
    x = f"{prose(56, 20)} {phrase} {prose(57, 40)} {first} inserted {second} {prose(58, 20)}"
    # two passages, each with a word in ten changed, 40 words apart
    lightly = [" ".join("zz" + w if i % 10 == 9 else w for i, w in enumerate(prose(60 + k, 70).split())) for k in (0, 1)]
    u = f"{prose(60, 70)} {prose(63, 40)} {prose(61, 70)}"
    v = f"{lightly[0]} {prose(64, 40)} {lightly[1]}"
    df = spark.createDataFrame([(0, y), (1, x), (2, u), (3, v)], "rid long, text string").coalesce(1)
    found = {}
    for r in passages.passages(df).collect():
        assert r.x_to - r.x_from >= passages.LEAST and r.identity >= passages.IDENTITY
        found.setdefault(r.x, []).append((r.x_from, r.x_to))
    assert {w for a, b in found[1] for w in range(a, b)} >= set(range(76, 133))
    covered = {w for a, b in found[3] for w in range(a, b)}
    assert len(covered & set(range(70))) >= 60 and len(covered & set(range(110, 180))) >= 60


def test_passage_whose_parts_have_other_leaders(spark):
    whole = prose(70, 90)
    parts = [" ".join(whole.split()[a : a + 36]) for a in (0, 27, 54)]  # every seed stands in one of them
    others = [f"{prose(80 + k, 30)} {part} {prose(90 + k, 30)}" for k, part in enumerate(parts)]
    texts = [*others, f"{prose(100, 30)} {whole} {prose(101, 30)}", f"{prose(102, 20)} {whole} {prose(103, 20)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3)
    found = [r for r in passages.passages(df).collect() if r.x == 4]
    assert {w for r in found for w in range(r.x_from, r.x_to)} >= set(range(20, 110)) and {r.y for r in found} == {3}


def test_passage_whose_seeds_all_have_earlier_leaders(spark):
    """Two rows share 100 words but for one in 11, and each stretch between changes leads elsewhere."""
    whole = prose(110, 100).split()
    parts = [" ".join(whole[a + 1 : a + 11]) for a in range(0, 99, 11)]
    others = [f"{prose(120 + k, 30)} {part} {prose(140 + k, 30)}" for k, part in enumerate(parts)]
    changed = [" ".join(f"{tag}{w}" if i % 11 == 0 else w for i, w in enumerate(whole)) for tag in ("yy", "xx")]
    texts = [*others, f"{prose(160, 30)} {changed[0]} {prose(161, 30)}", f"{prose(162, 20)} {changed[1]} {prose(163, 20)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3)
    found = [r for r in passages.passages(df).collect() if r.x == len(texts) - 1]
    assert {w for r in found for w in range(r.x_from, r.x_to)} >= set(range(21, 119)) and {r.y for r in found} == {len(texts) - 2}


def test_passages_of_every_two_different_texts(spark):
    """Of 12 edited versions every two are found, each of 30 equal texts with the first, and 30 rows with an equal passage hang together."""
    whole, other = prose(170, 120).split(), prose(171, 80)
    versions = [" ".join(f"v{k}{w}" if i % 24 == 2 * k % 24 else w for i, w in enumerate(whole)) for k in range(12)]
    texts = [*versions, *[prose(172, 70)] * 30, *[f"{prose(180 + k, 25)} {other} {prose(220 + k, 25)}" for k in range(30)]]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3)
    pairs = {(r.x, r.y) for r in passages.passages(df).collect()}
    assert pairs >= {(x, y) for x in range(12) for y in range(x)}
    assert {p for p in pairs if 12 <= p[0] < 42} == {(x, 12) for x in range(13, 42)}
    assert {p[0] for p in pairs if p[1] >= 42} == set(range(43, 72)) and len({p for p in pairs if p[0] >= 42}) < 29 * 15


def test_passages_of_many_edited_versions(spark):
    """Of a group all rows' words are found without matching every two; so are those that two late rows share and whose parts lead to other rows each."""
    n = 4 * passages.HOT
    whole = prose(400, 100).split()
    versions = [" ".join(f"v{k}{w}" if i % 25 == k % 25 else w for i, w in enumerate(whole)) for k in range(n)]
    lines = [prose(401 + k, 30) for k in range(3)]  # under LEAST words each, in many unrelated rows
    others = [f"{prose(500 + k, 25)} {line} {prose(1000 + k, 25)}" for k, line in enumerate(lines * passages.HOT)]
    joined = " ".join(lines)
    late = [f"{prose(410, 20)} {joined} {prose(411, 20)}", f"{prose(412, 25)} {joined} {prose(413, 25)}"]
    texts = [*versions, *others, *late]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3)
    found, covered = passages.passages(df).collect(), {}
    for r in found:
        covered.setdefault(r.x, set()).update(range(r.x_from, r.x_to))
    for k in range(1, n):
        assert covered[k] >= set(range(12, 88)), k
    assert covered[len(texts) - 1] >= set(range(25, 115)) and (len(texts) - 1, len(texts) - 2) in {(r.x, r.y) for r in found}
    assert not set(covered) & set(range(n, len(texts) - 1))
    assert len(found) < n * n / 5  # every two are n * (n - 1) / 2


def test_passages_of_many_rows_that_repeat_a_word(spark):
    """Rows that repeat a word are not matched each with every other; what an earlier one has too is found, also of two late rows that share several short repeats."""
    n = 2 * passages.HOT
    long = [50 + k % 7 * 10 for k in range(n)]
    texts = [f"{prose(500 + k, 25)} {'the ' * long[k]}{prose(700 + k, 25)}" for k in range(n)]
    texts += [f"{prose(900 + k, 25)} {f'{w} ' * 20}{prose(1100 + k, 25)}" for k, w in enumerate(["aa", "bb", "cc"] * passages.HOT)]  # under LEAST words each
    texts += [f"{prose(1300 + k, 25)} {'aa ' * 20}{'bb ' * 20}{'cc ' * 20}{prose(1310 + k, 25)}" for k in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3)
    assert passages._chains(passages.matches(df)).count() < n * n / 4  # every two are n * (n - 1) / 2
    found, covered = passages.passages(df).collect(), {}
    for r in found:
        covered.setdefault(r.x, set()).update(range(r.x_from, r.x_to))
    for k in range(7, n):
        assert covered[k] >= set(range(25, 25 + long[k])), k
    last = len(texts) - 1
    assert covered[last] >= set(range(25, 85)) and (last, last - 1) in {(r.x, r.y) for r in found}
    assert not set(covered) & set(range(n, last))


def test_passages_beyond_the_equal_words_of_a_class(spark):
    """A passage stands in many rows; the words after it and before it that two later rows share, and the first row has not, are found as well."""
    whole, before, after = prose(300, 70), prose(301, 6), prose(302, 6)
    texts = [f"{prose(310 + k, 25)} {before if k in (3, 5) else ''} {whole} {after if k in (2, 5) else ''} {prose(330 + k, 25)}" for k in range(7)]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3)
    covered, words = {}, [t.split() for t in texts]
    for r in passages.passages(df).collect():
        covered.setdefault(r.x, set()).update(range(r.x_from, r.x_to))
        if r.identity == 1:
            assert words[r.x][r.x_from : r.x_to] == words[r.y][r.y_from : r.y_to]
    assert covered[5] >= set(range(25, 107)) and covered[4] >= set(range(25, 95)) and 0 not in covered


def test_alignments_at_once_equal_those_one_by_one():
    r = np.random.default_rng(7)
    texts, chains = [], []
    for _ in range(300):
        x = r.integers(0, 40, int(r.integers(60, 200)))
        y = x.copy()
        y[r.random(len(y)) < r.choice([0.02, 0.1, 0.3])] = 99
        for _ in range(int(r.integers(0, 3))):
            y = np.insert(y, int(r.integers(0, len(y))), r.integers(50, 60, int(r.integers(1, 9))))
        grams = {}
        for j in range(len(y) - passages.K + 1):
            grams.setdefault(tuple(y[j : j + passages.K]), j)
        seeds = np.array([(i, grams[g]) for i in range(0, len(x) - passages.K + 1, 3) if (g := tuple(x[i : i + passages.K])) in grams], np.int64).reshape(-1, 2)
        for path in passages.chain(seeds[:, 0], seeds[:, 1]) if len(seeds) else []:
            if len(path) > 1:
                texts.append((x.astype(np.int32), y.astype(np.int32)))
                chains.append(passages.segments(seeds[path, 0], seeds[path, 1], np.zeros(1, np.int64))[0])
    sizes = np.array([[len(x), len(y)] for x, y in texts])
    of = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(-1, 2)
    first = np.cumsum([len(c) for c in chains]) - [len(c) for c in chains]
    which, rows = passages.align_many(np.concatenate([t for pair in texts for t in pair]), of[:, 0], sizes[:, 0], of[:, 1], sizes[:, 1], np.concatenate(chains), first)
    assert len(set(which.tolist())) > 100
    for k, (pair, parts) in enumerate(zip(texts, chains, strict=True)):
        plain, got = passages.align(*pair, parts), rows[which == k]
        assert {w for p in plain for w in range(p[0], p[1])} == {w for p in got for w in range(int(p[0]), int(p[1]))}
        assert all(min(abs(p - q).max() for q in np.array(plain)) < 1e-9 for p in got)


def test_passages_of_texts_that_repeat_themselves(spark):
    """Stretches of 2 and 9 words again and again, longer and shorter than before, between shared words: all is found, by few matches."""
    line, head, tail = prose(260, 9), prose(261, 30), prose(262, 30)
    texts = [f"{head} {' '.join([unit] * n)} {tail}" for unit, sizes in (("ab cd", (100, 300, 40)), (line, (20, 70, 6))) for n in sizes]
    df = spark.createDataFrame([(i, f"{prose(270 + i, 12)} {t} {prose(280 + i, 12)}") for i, t in enumerate(texts)], "rid long, text string").coalesce(1)
    covered = {}
    for r in passages.passages(df).collect():
        covered.setdefault(r.x, set()).update(range(r.x_from, r.x_to))
    for i, t in enumerate(texts):
        if i in (1, 2, 4, 5):
            assert covered[i] >= set(range(14, 10 + len(t.split()))), i
    assert passages.matches(df).selectExpr("sum(size(y)) n").first().n < 5000


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_runs_on_a_small_table(spark, docs, tmp_path, rows):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in (4, 6))) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:5] == docs.columns and {"ids", "n_tokens"} <= set(out.columns)
    got = out.collect()
    assert 0 < len(got) <= len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "mixing", "sentencepiece"]
