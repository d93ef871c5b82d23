"""Operators on small tables: odd rows, and results against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from seamline.llm import chunking, crossparse, decontamination, licenses, matroska, mixing, registry, segments, sharding, superminhash, warc
from seamline.llm.components import connected

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, block string, score string, label string, position string"
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = words(60, 99)
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, words(200, 1)), (6, words(200, 1)), (7, words(200, 1)), (8, words(200, 1).replace(" ", "  ").upper()),
    (9, words(40, 2) + " " + PASSAGE + " " + words(30, 3)), (10, words(10, 4) + "\n" + PASSAGE + "\n" + words(50, 5)), (11, words(30_000, 6)), (12, "!!! ... ???"), (13, "the " * 300), (None, "no id here"), (14, "ünïcödé " * 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, None if (d or 0) % 2 else "xx", None if d in (4, 5) else "src", len(t or ""), "s", "b", "c", "l", "p") for d, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, percent):
    sets = {d: shingle_set(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates_of_odd_rows(odd, none):
    got = superminhash.near_duplicates(odd.where("doc_id IS NOT NULL"), width=3, percent=85, bands=20).collect()
    want = brute_components([x for x in ODD if x[0] is not None], 3, 85)
    assert len(got) == 15
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert superminhash.near_duplicates(none).count() == 0


def test_near_duplicate_family_with_chains(spark):
    """A family around the threshold: many texts differ by edits, so leaders alone don't find every link."""
    base, rows = words(120, 7).split(), []
    for i in range(90):
        r, text = random.Random(i), list(base)
        for _ in range(r.randrange(0, 9)):
            text[r.randrange(len(text))] = "w%d" % r.randrange(10**6)
        rows.append((1000 - i, " ".join(text)))
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85, bands=20).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, 85)


def test_near_duplicates_of_many_short_texts(spark):
    """Batches of more short texts than one step takes, some of them without words."""
    rows = [(i, None if i % 5 == 0 else f"a{i // 10} b{i // 10} c d{i % 10 // 6}") for i in range(10_000)]
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), width=3, percent=85, bands=20).collect()
    first, want = {}, {}
    for i, text in rows:
        want[i] = (2 if text else 0, first.setdefault(text, i) if text else i)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_of_repeated_keys(spark):
    """One key with two texts: each of them has a near copy, and the copies' groups stay apart."""
    a, b = words(150, 21), words(160, 22)
    rows = [(1, a), (1, b), (1, b), (2, a + " x"), (3, b + " y"), (4, words(50, 23)), (5, a + " x")]
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85, bands=20).collect()
    want = [(1, 148, 1), (1, 158, 1), (1, 158, 1), (2, 149, 1), (3, 159, 1), (4, 48, 4), (5, 149, 1)]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (60, 60), (70, 40), (70, 41), (None, 3)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 70: 40, 40: 40, 41: 40}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_passages(odd, none, spark):
    got = chunking.repeated_passages(odd).collect()
    docs = {r.doc_id for r in got}
    assert docs >= {6, 7, 9, 10} and not docs & {1, 2, 3, 4, 5, 11, 12, 14}
    text = dict(ODD)
    for r in got:
        if r.doc_id in (9, 10):
            assert PASSAGE in text[r.doc_id].encode()[r.start : r.start + r.n_bytes].decode().replace("\n", " ") or r.n_words >= 51
    assert {r.keeper_id for r in got if r.doc_id == 10} == {9}
    assert chunking.repeated_passages(none).count() == 0
    wide = spark.createDataFrame([((1 << 50) + d, t) for d, t in ODD if d in (9, 10)], "doc_id long, text string")
    assert {r.doc_id - (1 << 50) for r in chunking.repeated_passages(wide).collect()} == {9, 10}


def shared_windows(rows, width):
    """Texts that have a window of ``width`` words which another text has too."""
    owners = defaultdict(set)
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - width + 1):
            owners[tuple(w[i : i + width])].add(d)
    return {d for o in owners.values() if len(o) > 1 for d in o}


def test_repeated_passages_recall(spark):
    r = random.Random(23)
    stock = [words(r.randrange(8, 20), 7000 + i) for i in range(12)]
    passages = [words(r.randrange(51, 80), 8000 + i) for i in range(25)]
    rows = []
    for d in range(240):
        parts = [words(r.randrange(5, 60), 9000 + d), r.choice(stock), words(r.randrange(5, 60), 9500 + d)]
        if d % 3 == 0:
            parts.insert(r.randrange(4), r.choice(passages))
        rows.append((d, "\n".join(parts)))
    want = shared_windows(rows, 51)
    got = {x.doc_id for x in chunking.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 60 and len(got & want) >= 0.98 * len(want) and not got - want


def test_short_runs_grow_as_far_as_texts_agree(spark):
    shared = [w * 8 for w in words(60, 31).split()]
    one, two = "a b " + " ".join(shared) + " x", "some other " + " ".join(shared) + " end"
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    size = len(shared[30])
    runs = spark.createDataFrame([(2, 1, two.index(shared[30]), one.index(shared[30]), size, 1)], "doc long, keeper long, start int, keeper_start int, size int, words int")
    assert len(" ".join(shared)) > 4 * chunking.REACH
    (got,) = chunking.lengthened(runs, docs, 51).collect()
    assert got.words >= 51 and " ".join(shared[10:50]) in two[got.start : got.start + got.size]


def test_matroska_columns(odd, none):
    stored = matroska.store(odd)
    got = {(r.doc_id, r.payload_sha256): r for r in matroska.read_back(stored).collect()}
    for d, t in ODD:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[d, hashlib.sha256(payload).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
    packets = matroska.packets(stored.where("doc_id = 11")).collect()
    assert {p.lacing for p in packets} >= {"fixed", "ebml", "xiph"}
    assert [p.timestamp for p in sorted(packets, key=lambda p: p.packet)] == [72 * i for i in range(len(packets))]
    assert matroska.cues(stored.where("doc_id = 11")).count() == -(-len(packets) // 256)
    assert matroska.read_back(matroska.store(none)).count() == 0
    assert matroska.packets(stored.selectExpr("doc_id", "CAST(NULL AS BINARY) media")).count() == 0


def brute_contamination(docs, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for k, t in items:
        w = split(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add(str(k))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, PASSAGE), (2, words(25, 5)), (3, "one two"), (4, None), (5, "..."), (6, "the " * 12), (10, PASSAGE.upper() + " more"), (7, words(30, 77)), (1, "ünïcödé " * 10)]


def test_decontamination_of_odd_rows(odd, none, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(map(key, decontamination.decontaminate(odd, items).collect()))
    assert got == sorted(map(key, brute_contamination(ODD, ITEMS)))
    assert decontamination.decontaminate(none, items).count() == 0
    assert {r.n_hit for r in decontamination.decontaminate(odd, items.limit(0)).collect()} == {0}


def test_phrases_and_proximity(odd, spark):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    _, found = decontamination.phrase_matches(odd, items)
    assert {(r.doc, r.hits[0].start, r.hits[0].words) for r in found.collect()} == {(9, 40, 60), (10, 10, 60)}


def brute_proximity(rows, items, slop):
    """(doc, item) of texts where the two least frequent words of an item stand ``slop`` places apart at most."""
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts, found = defaultdict(int), set()
    for _, t in rows:
        for w in tokens(t):
            counts[w] += 1
    for item, t in items:
        rare = sorted(dict.fromkeys(tokens(t)), key=lambda w: counts[w])[:2]  # a stable sort: ties by first place
        for doc, text in rows:
            own = tokens(text)
            at = [[i for i, w in enumerate(own) if w == x] for x in rare]
            if doc is not None and rare and (at[0] if len(rare) == 1 else any(abs(i - j) <= slop for i in at[0] for j in at[1])):
                found.add((doc, str(item)))
    return found


@pytest.mark.parametrize("slop", [1, 8, 60])
def test_proximity_equals_brute_force(odd, none, spark, slop):
    items = [*ITEMS, (11, "two one"), (12, "here no"), (13, words(10, 6)), (14, "one absentword")]
    table = spark.createDataFrame(items, "item_id long, text string")
    own, counts = decontamination.item_terms(table), decontamination.term_counts(odd)
    found = decontamination.proximity_matches(decontamination.build_index(odd), own, counts, slop).collect()
    want = brute_proximity(ODD, items, slop)
    assert {(r.doc, r.item) for r in found} == want and all(0 <= r.spread <= slop for r in found)
    per = {(r.doc_id, r.n_near) for r in decontamination.decontaminate(odd, table, slop=slop).collect()}
    assert per == {(d, len({i for doc, i in want if doc == d})) for d, _ in ODD}
    assert decontamination.decontaminate(none, table, slop=slop).count() == 0
    assert {r.n_near for r in decontamination.decontaminate(odd, table.limit(0), slop=slop).collect()} == {0}


def test_language_of_odd_rows(odd, none, spark):
    train = spark.createDataFrame([(i, words(80, 100 + i) if i % 2 else "zorro zumba zar " * 20, "aa" if i % 2 else "zz") for i in range(20)], "doc_id long, text string, lang string")
    model = crossparse.fit(train)
    assert model.langs == ["aa", "zz"]
    got = {(r.doc_id, r.lang_pred) for r in crossparse.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (12, "und"), (6, "aa"), (11, "aa")} <= got
    carried = crossparse.identify(odd, model, carry=True)
    assert carried.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score", "bits_per_char"] and carried.count() == 16
    assert crossparse.identify(none, model).count() == 0
    empty = crossparse.fit(train.limit(0))
    assert {r.lang_pred for r in crossparse.identify(odd, empty).collect()} == {"und"}


def test_language_is_learned_beyond_shared_heads(spark):
    head, rows = words(400, 1), []
    for i in range(40):
        rows.append((i, head + " " + " ".join(("zorro", "zumba", "yoyo", "quux")[(i * j * j + j) % 4] if i % 2 else ("mimi", "lolo", "nono", "susu")[(i * j * j + j) % 4] for j in range(900)), "zz" if i % 2 else "mm"))
    model = crossparse.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    probe = spark.createDataFrame([(1, "zumba quux zorro yoyo " * 9), (2, "lolo susu mimi nono " * 9)], "doc_id long, text string")
    got = crossparse.identify(probe, model).collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(1, "zz"), (2, "mm")} and min(r.score for r in got) > 0.9


def test_toxic_segments(odd, none, spark):
    rows, marks = [], []
    for i in range(160):
        bad = i % 4 == 0
        rows.append((i, words(150, i) + (" vile scum" if bad else "") + " " + words(50, 900 + i)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (3, 0), (None, 1), (999, None)], "doc_id long, toxic int")
    model = segments.fit(docs, labels)
    got = {r.doc_id: r for r in segments.score(docs, model).collect()}
    assert all(got[i].predicted == y for i, y in marks)
    found = [r.passage for r in segments.passages(docs, model).collect()]
    assert len(found) >= 40 and all("vile scum" in p for p in found)
    strange = segments.score(odd, model).collect()
    assert len(strange) == 16 and all(0 <= r.score <= 1 and r.predicted == 0 for r in strange)
    assert segments.score(none, model).count() == 0
    blank = segments.fit(docs, labels.limit(0))
    assert {r.predicted for r in segments.score(docs, blank).collect()} == {0}


def test_shards_claim_slots_by_turns(spark):
    for size, n in ((7, 10), (101, 101), (1009, 5), (211, 48)):
        names = sharding.shard_names(spark, n)
        shards = sorted(sharding.preferences(names, size).collect(), key=lambda r: r.turn)
        want, free = {}, set(range(size))
        for turn in range(size):
            own = shards[turn % n]
            slot = next(x for k in range(size) if (x := (own.offset + k * own.skip) % size) in free)
            free.remove(slot)
            want[slot] = own.shard
        assert {r.slot: r.shard for r in sharding.lookup_table(names, size).collect()} == want
    nothing = spark.createDataFrame([], "shard string")
    assert sharding.lookup_table(nothing, 7).count() == 0
    placed = sharding.place(spark.createDataFrame([(1,)], "doc_id long"), sharding.lookup_table(nothing, 7), size=7).first()
    assert placed.slot is not None and placed.shard is None


def test_sharding(odd, none, spark):
    table = sharding.lookup_table(sharding.shard_names(spark, 7), 211)
    slots = {r.slot: r.shard for r in table.collect()}
    assert sorted(slots) == list(range(211))
    sizes = [list(slots.values()).count(s) for s in set(slots.values())]
    assert max(sizes) - min(sizes) <= 1
    placed = sharding.place(odd, table, size=211)
    assert placed.count() == 16 and placed.where("shard IS NULL").count() == 0 and placed.columns.count("slot") == 1
    assert placed.where("doc_id = 6").select("shard").distinct().count() == 1
    assert sharding.place(none, table, size=211).count() == 0
    fewer = {r.slot: r.shard for r in sharding.lookup_table(sharding.shard_names(spark, 7).where("shard <> 'shard-0003'"), 211).collect()}
    assert sum(slots[s] != fewer[s] for s in slots) < 211 * 0.35
    with pytest.raises(ValueError):
        sharding.lookup_table(sharding.shard_names(spark, 7), 210)


def test_mixing(odd, none, spark):
    rows = [(i, None if i % 9 == 0 else "s%d" % (i % 4)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = spark.createDataFrame([("s0", 5.0), ("s1", 3.0), ("s2", 1.0), ("s3", -1.0)], "name string, weight double")
    got = mixing.mix(docs, weights.union(weights.limit(1)), block=4).collect()
    assert len(got) == 900 == len({r.position for r in got})
    share = {None: 1, "s0": 5, "s1": 3, "s2": 1, "s3": 1}
    by = defaultdict(set)
    for r in got:
        by[r.source].add((r.block, r.slot))
    for name, blocks in by.items():
        assert {k for k, _ in blocks} == set(range(len(blocks)))
        for block, slot in blocks:  # block k runs between its release and its deadline
            assert block * 11 // share[name] <= slot < -(-(block + 1) * 11 // share[name])
    assert mixing.mix(odd, mixing.target_weights(odd)).count() == 16
    assert mixing.mix(odd, mixing.target_weights(none)).count() == 16
    assert mixing.mix(none, mixing.target_weights(none)).count() == 0


@pytest.mark.parametrize("weights", [[139.6, *[45.2842] * 19], [30.0, *[1.0] * 1100], [1 / 3, 0.1, 2**0.5, 1e-3, 7.0, 0.25, 11.3, 3.14159], [1e-300, 1.0, 1e300]])
def test_deviation_stays_below_one_block(weights):
    """Of exact weights, at every slot, for as long as all sources have blocks."""
    whole = mixing.whole_weights(weights)
    total, done = sum(whole), [0] * len(weights)
    slots = 20_000 if len(weights) < 100 else 3000
    for t, (i, block, slot) in zip(range(slots), mixing.earliest_deadline(whole, [10**9] * len(weights))):
        assert slot == t and block == done[i]
        done[i] += 1
        if t % 97 == 0 or len(weights) < 9:
            assert all(abs(n * total - (t + 1) * w) < total for n, w in zip(done, whole))


def test_ended_sources_leave_the_others_in_their_windows():
    weights, blocks = mixing.whole_weights([5.0, 2.5, 0.3, 0.0]), [3, 40, 11, 2]
    total, seen = sum(weights), defaultdict(list)
    for i, k, slot in mixing.earliest_deadline(weights, blocks):
        assert k * total // weights[i] <= slot < -(-(k + 1) * total // weights[i])
        seen[i].append(slot)
    assert [len(seen[i]) for i in range(4)] == blocks
    assert len({t for s in seen.values() for t in s}) == sum(blocks)


def test_warc_records(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<html lang='EN'><title>A &amp; B</title><script>no</script><p>Hi <b>you</b></p><a href='/l'>link</a>"), (2, None, None), (3, "u", ""), (3, "u", "")], "page_id long, url string, html string")
    got = warc.derivatives(warc.responses(pages)).collect()
    assert len(got) == 8
    one = {r.record_type: r for r in got if r.page_id == 1}
    assert one["conversion"].block == "A & B\nHi you\nlink" and "outlink: /l L a/@href" in one["metadata"].block and "title: A & B\r\nlanguage: en" in one["metadata"].block
    for r in warc.serialised(warc.derivatives(warc.responses(pages))).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        own = one[r.record_type] if r.page_id == 1 else None
        if own:
            lines = head.decode().split("\r\n")
            assert fields["WARC-Refers-To-Payload-Digest"] == own.source_payload_digest
            assert [x.removeprefix("WARC-Source-Header: ") for x in lines if x.startswith("WARC-Source-Header: ")] == own.source_headers.split("\r\n")[:-2]
            other = one["conversion" if r.record_type == "metadata" else "metadata"]
            assert fields["WARC-Concurrent-To"] == f"<{other.record_id}>"
        assert rest[len(block) :] == b"\r\n\r\n" and fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and fields["WARC-Refers-To"].startswith("<urn:uuid:")
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "code"), ("a/b/NOTICE", "This work is licensed under the GNU General Public License, version 3.\nmore"),
        ("a/y.py", "x\nLicensed under CC BY-NC 4.0.\ny"), ("z/q.py", None), (None, ""), ("a/b/c/x.py", "code"), ("a/t.py", "a permission to speak about anything at all in this long line"),
    ]
    files = spark.createDataFrame([(*r, "extra") for r in rows], "path string, text string, licence string")
    got = {(r.path, r.licence, r.inherited_from) for r in licenses.scan(files).collect()}
    assert got == {("a/LICENSE", "MIT", None), ("a/b/c/x.py", "GPL-3.0", "a/b"), ("a/b/NOTICE", "GPL-3.0", None), ("a/y.py", "CC-BY-NC-4.0", None), ("z/q.py", None, None), (None, None, None), ("a/t.py", "MIT", "a")}
    assert licenses.scan(files).count() == 8 and licenses.scan(files.limit(0)).count() == 0


def test_licences_over_lines_and_inside_long_texts(spark):
    filler = words(20_000, 7)
    texts = {
        "wrapped": "/*\n * Permission is hereby granted, free\n * of charge, to any person obtaining a\n * copy of this software and associated\n * documentation files\n */\ncode",
        "inside": filler + " Copyright 2024 Acme Corp. All rights reserved. Some more " + filler,
        "start": "reserved. " + filler, "other": "a licence to speak, if permission is given, of reserved seats", "share": "x Licensed under CC BY-SA 4.0. y",
        "lesser": "under the terms of the GNU Lesser General Public\nLicense, version 3.", "repeats": "license " * 500,
    }
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {r.path: r.own_licence for r in licenses.own_licences(files).collect()}
    assert got == {"wrapped": "MIT", "inside": "proprietary", "share": "CC-BY-SA-4.0", "lesser": "LGPL-3.0"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_registered_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(registry.ORACLES[name])
    cols = [c[0] for c in cur.description]
    tidy = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    want = sorted(map(repr, map(tidy, cur.fetchall())))
    got = registry.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, map(tidy, map(tuple, got.select(*cols).collect())))) == want
