"""Plain-Python parts against brute force; no Spark."""

import random
import re
import struct
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seamline.llm import chunking, crossparse, matroska, segments, superminhash
from seamline.llm.common import ALNUM, SPACED, Words, runs, sliced

TEXT = st.text(alphabet="abAB09 .\n\té語-", max_size=60)


@settings(deadline=None, max_examples=60)
@given(st.lists(TEXT, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    for table, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = Words(pa.array(texts, pa.string()), table)
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
        want = [re.findall(pattern, t) for t in lower]
        assert np.diff(words.starts).tolist() == [len(w) for w in want]
        seen = {}
        for h, w in zip(words.hashes.tolist(), [w for ws in want for w in ws]):
            assert seen.setdefault(h, w) == w
        assert len(set(seen.values())) == len(seen)


def test_short_texts_are_one_run():
    words = Words(pa.array(["a b c d", "a b", "", "a b"]), SPACED)
    values, texts = runs(words.hashes, words.starts, 3)
    assert sorted(texts.tolist()) == [0, 0, 1, 3]
    assert len(set(values.tolist())) == 3


def test_pieces_hold_a_row_at_least():
    batch = pa.record_batch({"t": pa.array(["x" * 50, None, "", "y" * 5])})
    assert [p.num_rows for p in sliced(batch, "t", 10)] == [1, 3]


def plain_superminhash(values, size):
    """The signature element by element, each with its own permutation."""
    out = [np.iinfo(np.uint64).max] * size
    for v in values:
        seed = superminhash.mix(np.array([v], np.uint64) + np.uint64(0x632BE59BD9B4E019))
        order = list(range(size))
        for j in range(size):
            d = int(superminhash.mix(seed + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[0])
            k = j + (d & 0xFFFFFF) % (size - j)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j << 40 | d >> 24)
    return out


def test_signature_equals_the_elementwise_one():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 52, n, dtype=np.uint64)) for n in (1, 3, 0, 40, 300)]
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    found = superminhash.signatures(np.concatenate(sets), starts, 16)
    for s, row in zip(sets, found.tolist()):
        assert row == plain_superminhash(s.tolist(), 16)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 52, 400, dtype=np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 1 << 52, 100, dtype=np.uint64)))
    found = superminhash.signatures(np.concatenate((a, b)), np.array([0, 400, 800]), 1024)
    assert abs((found[0] == found[1]).mean() - 300 / 500) < 0.05


def all_maximal(scores):
    """Ruzzo and Tompa's segments by their definition: the best of what is left, then both sides of it."""
    out = []

    def go(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best and best[0] > 0:
            out.append((best[3], best[4]))
            go(a, best[3])
            go(best[4], b)

    go(0, len(scores))
    return sorted(out)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from([-1.0, -1.0, -1.0, 2.5, 4.25, -3.0625]), max_size=14))
def test_segments_are_the_maximal_ones(scores):
    odd = [(i, s) for i, s in enumerate(scores) if s != -1.0]
    found = segments.maximal_segments([i for i, _ in odd], [s for _, s in odd], -1.0)
    assert sorted((a, b) for a, b, _ in found) == all_maximal(scores)
    for a, b, s in found:
        assert s == pytest.approx(sum(scores[a:b]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segments_of_a_longer_text(seed):
    r = random.Random(seed)
    scores = [r.uniform(-1.5, 1.2) for _ in range(70)]
    found = segments.maximal_segments(list(range(70)), scores, -1.0)
    assert [(a, b) for a, b, _ in found] == all_maximal(scores)


def steps_of(call):
    """Lines that ``call`` runs inside maximal_segments: a measure of its work that doesn't depend on the machine."""
    lines = 0

    def inside(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return inside

    sys.settrace(lambda frame, event, arg: inside if frame.f_code is segments.maximal_segments.__code__ else None)
    try:
        call()
    finally:
        sys.settrace(None)
    return lines


@pytest.mark.parametrize("kind", ["down", "up", "mixed"])
def test_segments_take_linear_steps(kind):
    r = random.Random(5)
    n = 100_000
    scores = {"down": [0.5, -0.7] * (n // 2), "up": [0.7, -0.5] * (n // 2), "mixed": [r.uniform(-1.3, 1.0) for _ in range(n)]}[kind]
    assert steps_of(lambda: segments.maximal_segments(list(range(n)), scores, -0.1)) < 40 * n


def test_automaton_knows_exactly_the_substrings():
    rng = random.Random(3)
    codes = [rng.randrange(3) for _ in range(60)]
    table = crossparse.automaton(codes, 3)
    text = "".join(map(str, codes))
    for _ in range(500):
        probe = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        state, fine = 0, True
        for c in probe:
            state = table[state, c]
            fine &= bool(state)
            if not state:
                break
        assert fine == ("".join(map(str, probe)) in text)


def test_phrases_are_greedy():
    model = crossparse.Model({"x": ["abcabd abd"], "y": ["zzz"]})
    text = "abdabcz q"
    kinds = model.kinds[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    n = crossparse.phrases(model, kinds, np.array([0, len(kinds)]))

    # abdabcz q: "abd", "abc" (a phrase that "z" ends), then letters and blanks that start no longer phrase
    def greedy(codes, sample):
        text_, known = "".join(map(chr, codes)), "".join(map(chr, sample))
        count, phrase = 0, ""
        for c in text_:
            if phrase + c in known:
                phrase += c
            else:
                count += 1
                phrase = c if c in known else ""
        return count + bool(phrase)

    sample = crossparse.squeeze(model.kinds[np.frombuffer("abcabd abd".encode("utf-32-le"), np.uint32)])
    assert n[0, 0] == greedy(kinds.tolist(), sample.tolist())


def test_every_letter_of_the_sample_has_its_own_code():
    rng = random.Random(5)
    signs = [chr(0x4E00 + i) for i in range(2000)]
    samples = {"a": "".join(rng.choice(signs) for _ in range(3000)), "b": "".join(rng.choice(signs) for _ in range(3000))}
    model = crossparse.Model({lang: [t] for lang, t in samples.items()})
    assert len({int(model.kinds[ord(c)]) for t in samples.values() for c in t}) == len({c for t in samples.values() for c in t})
    text = samples["a"][700:1000] + samples["b"][40:43] + "x"
    kinds = model.kinds[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    got = crossparse.phrases(model, kinds, np.array([0, len(kinds)]))[0]

    def greedy(known):
        count, phrase = 0, ""
        for c in text:
            if phrase + c in known:
                phrase += c
            else:
                count, phrase = count + 1, c if c in known else ""
        return count + bool(phrase)

    assert got.tolist() == [greedy(samples["a"]), greedy(samples["b"])]


def test_chunks_survive_an_insertion():
    rng = random.Random(1)
    body = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(2000))
    both = []
    for text in (body, body[:3000] + "inserted words" + body[3000:]):
        b = np.frombuffer(text.encode(), np.uint8)
        edges = chunking.cuts(b, np.array([0, len(b)]))
        assert edges[0] == 0 and edges[-1] == len(b) and np.diff(edges).max() <= chunking.MOST
        both.append({text.encode()[x:y] for x, y in zip(edges, edges[1:])})
    assert len(both[0] & both[1]) >= len(both[0]) - 4


def test_neighbours_in_a_step_do_not_change_chunks():
    texts = ["the quick brown fox jumps over the lazy dog and runs away from all the other animals " * 3, "x" * 700, "héllo wörld " * 40]
    alone = []
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        alone += np.diff(chunking.cuts(b, np.array([0, len(b)]))).tolist()
    joined = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    assert np.diff(chunking.cuts(joined, offsets)).tolist() == alone


@pytest.mark.parametrize("n", [0, 1, 576, 577, 576 * 300 + 5])
def test_matroska_round_trip(n):
    text = bytes(random.Random(n).randrange(255) for _ in range(n))
    payload = matroska.padded(text)
    data = matroska.write(payload)
    found = matroska.parse(data)
    assert b"".join(data[p[3] : p[3] + p[4]] for p in found["packets"]) == payload
    assert [p[1] for p in found["packets"]] == [i * matroska.FRAME_MS for i in range(len(payload) // 576)]
    assert {c[2] for c in found["cues"]} == {data.index(b"\x1f\x43\xb6\x75", c[2]) for c in found["cues"]}
    assert found["tracks"][1]["bits"] == 8


def test_matroska_lacing_of_unequal_frames_and_unknown_sizes():
    frames = [b"a" * 700, b"b" * 3, b"", b"c" * 255]
    for kind in ("xiph", "ebml"):
        block = b"\x81" + struct.pack(">h", -5) + bytes([matroska.LACES.index(kind) << 1]) + matroska.lace(frames, kind)
        group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block) + matroska.number(matroska.BLOCK_DURATION, 40) + matroska.element(matroska.REFERENCE_BLOCK, b"\x01"))
        cluster = b"\x1f\x43\xb6\x75\xff" + matroska.number(matroska.TIMESTAMP, 100) + group
        data = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + cluster + cluster
        found = matroska.parse(data)
        assert [data[p[3] : p[3] + p[4]] for p in found["packets"]] == frames * 2
        assert [(p[1], p[2], p[5]) for p in found["packets"][:4]] == [(95 + 10 * i, 10, False) for i in range(4)]


@pytest.mark.parametrize("data", [b"", b"\x00", b"\x1a\x45\xdf\xa3\x85ab", b"RIFF0000"])
def test_matroska_refuses_what_is_broken(data):
    with pytest.raises(matroska.Malformed):
        matroska.parse(data)


def test_words_of_the_toxicity_model_are_those_of_a_full_count(spark):
    """Common words with a large exact z among them, which log a / n alone would miss."""
    import math
    import random
    from collections import Counter

    from seamline.llm.common import ALNUM, Words

    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        own = [w for k, w in enumerate(words) if r.random() < 0.03 + (0.2 if toxic and k % 40 == 0 else 0) - (0.02 if toxic and k % 25 == 1 else 0)]
        own += ["common"] if r.random() < (0.9 if toxic else 0.7) else []
        own += ["rare"] * (3 if toxic and i % 90 == 0 else 0)
        r.shuffle(own)
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = segments.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    count = {y: Counter(w for (_, t), (_, l) in zip(rows, labels) if l == y for w in set(t.split())) for y in (0, 1)}
    n = {y: sum(l == y for _, l in labels) for y in (0, 1)}
    want = {}
    for w in count[0].keys() | count[1].keys():
        a, b = count[1][w] + 0.5, count[0][w] + 0.5
        delta = math.log(a / (n[1] + 1 - a)) - math.log(b / (n[0] + 1 - b))
        if abs(delta) / math.sqrt(1 / a + 1 / b) >= 3:
            want[w] = min(12, max(-8, delta)) - 0.1
    hashes = Words(pa.array([" ".join(want)]), ALNUM).hashes.tolist()
    assert "common" in want and "rare" in want and len(want) > 8
    assert {int(t): round(float(s), 9) for t, s in zip(model.terms, model.scores)} == {h: round(s, 9) for h, s in zip(hashes, want.values())}


def test_repeated_ranges_have_the_keepers_bytes(spark):
    """Passages of two- and three-byte letters: the same bytes in both texts, whole characters, all found."""
    import random

    r = random.Random(12)
    letters = "абвгдежзиклмнопрстуфхцчшщыэюя日本語漢字仮名文書"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(1, 9)))
    rows = []
    for i in range(0, 400, 2):
        passage = " ".join(word() for _ in range(r.randrange(51, 140)))
        for d in (i, i + 1):
            rows.append((d, " ".join(word() for _ in range(r.randrange(0, 60))) + r.choice([" ", "\n"]) + passage + " " + " ".join(word() for _ in range(r.randrange(0, 60)))))
    texts = {d: t.encode() for d, t in rows}
    found = chunking.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    copies = {(f.doc_id, f.keeper_id): texts[f.doc_id][f.start : f.start + f.n_bytes].decode() for f in found}
    assert {d for d, _ in copies} == set(texts)
    for f in found:
        if not f.is_keeper:
            assert copies[f.doc_id, f.keeper_id].split() == copies[f.keeper_id, f.keeper_id].split()


def test_phrases_go_on_over_pieces():
    """Texts of many pieces, continuations of the samples among them, against a greedy parse of the whole text."""
    r = random.Random(9)
    samples = {"a": "".join(r.choice("abc ") for _ in range(3000)), "b": "".join(r.choice("abcdefgh") for _ in range(3000)), "c": "ab" * 1500}
    model = crossparse.Model({k: [t] for k, t in samples.items()})
    coded = lambda t: crossparse.squeeze(model.kinds[np.frombuffer(t.encode("utf-32-le"), np.uint32)]).tolist()
    known = {k: "".join(map(chr, coded(t + " "))) for k, t in samples.items()}  # a blank ends a sample

    def greedy(codes, text_):
        count, phrase = 0, ""
        for c in map(chr, codes):
            if phrase + c in text_:
                phrase += c
            else:
                count, phrase = count + 1, c if c in text_ else ""
        return count + bool(phrase)

    texts = [samples["a"][100:2100], "ab" * 2000, "", "x", "".join(r.choice("abcx ") for _ in range(5000)), samples["b"][:512], samples["b"][7 : 7 + 1024] + samples["c"][:513], samples["b"][9:2900], "a"]
    codes = [coded(t) for t in texts]
    got = crossparse.phrases(model, np.array([c for x in codes for c in x], model.kinds.dtype), np.cumsum([0, *map(len, codes)]))
    assert got.tolist() == [[greedy(x, known[k]) for k in sorted(known)] for x in codes]
    assert got[0, 0] == 1


def test_damaged_media_are_reported(spark):
    from seamline.llm import matroska

    good = matroska.write(matroska.padded(b"some text " * 200))
    bad = [b"junk", good[: len(good) // 2], bytes([255]) * 50, good.replace(b"A_PCM", b"\xff\xfe\xfd\xfc\xfb", 1), good[:40] + b"\x01" * 9 + good[49:], b""]
    rows = [(0, bytearray(good)), (99, None), *((i + 1, bytearray(b)) for i, b in enumerate(bad))]
    df = spark.createDataFrame(rows, "doc_id long, media binary")
    read = {r.doc_id: r for r in matroska.read_back(df).collect()}
    assert set(read) == set(range(len(bad) + 1)) and read[0].error is None and read[0].n_bytes == 2000
    assert all(read[i].error and read[i].payload_sha256 is None and read[i].media_bytes == len(bad[i - 1]) for i in (1, 2, 3, 6))
    for table in (matroska.packets(df), matroska.cues(df)):
        found = table.collect()
        assert {r.doc_id for r in found if r.error} >= {1, 2, 3, 6}
        assert all(r.track is None for r in found if r.error) and any(r.doc_id == 0 and r.error is None for r in found)
