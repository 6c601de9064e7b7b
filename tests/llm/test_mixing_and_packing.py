import hashlib
import zlib
from collections import defaultdict
from math import gcd

import numpy as np
import pytest

from riskloom.llm import mixing, packing
from riskloom.llm.bins import best_fit, completions, least_bins, pack_counts
from riskloom.llm.tokens import token_ids


def test_lattice_visits_every_slot_once(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000, 65_536, 2_000_003):
        step = mixing.lattice_step(n)
        assert gcd(step, n) == 1
    seen = spark.range(65_536).select(mixing.lattice_point(F.col("id"), mixing.lattice_step(65_536), 65_536).alias("p"))
    assert seen.distinct().count() == 65_536
    big = 2_000_000_000_003
    step = mixing.lattice_step(big)
    ids = [0, 1, 12345, big // 3, big - 1]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = [r[0] for r in df.select(mixing.lattice_point(F.col("id"), step, big)).collect()]
    assert sorted(got) == sorted(i * step % big for i in ids)


def water_level(sizes, weights, most=3):
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = [most * sizes[i] if i in full else weights[i] * rest / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if target[i] > most * sizes[i]}
        if not over:
            return target
        full |= over


def test_targets_and_takings(spark, docs_of):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        source = [None, "a", "b", "é", "z"][int(rng.choice(5, p=[0.1, 0.02, 0.5, 0.28, 0.1]))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))), None, source))
    rows += [(1000, None, None, "empty"), (1001, " \n", None, "empty"), (5, "a b c", None, "b"), (5, "a b c", None, "b")]
    mix = mixing.mix_sources(docs_of(rows), block_words=32)
    got = mixing.words_taken(mix).collect()
    assert sorted(r.key for r in got) == sorted(r[0] for r in rows)
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    target = dict(zip(names, water_level([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    # The sources are spread over the schedule: every tenth of it is close to the weights.
    slots = mix.slots.orderBy("slot").collect()
    shares = defaultdict(int)
    for s in slots:
        shares[s.position] += 1
    tenth = len(slots) // 10
    for k in range(10):
        part = slots[k * tenth:(k + 1) * tenth]
        for position, n in shares.items():
            assert abs(sum(s.position == position for s in part) - n * tenth / len(slots)) <= 3
    again = mixing.words_taken(mixing.mix_sources(docs_of(rows).repartition(7), block_words=32)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents_keep_columns(docs_of):
    docs = docs_of([(1, "a b c", None, "s"), (2, "d e f", None, "s"), (3, None, None, None), (4, "g " * 90, None, "t")])
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert 3 in [r.doc_id for r in got.collect()]
    assert mixing.mixed_documents(docs.where("false")).count() == 0


def test_rows_without_keys_are_told_apart_by_their_texts(spark, docs_of):
    """Null keys, one source, equal sizes: each text is given as often as the mix takes it."""
    rows = [(None, f"a{k} b{k} c{k}", None, "s") for k in range(40)] + [(None, "same words here", None, "s")] * 5 + [(7, "x " * 2000, None, "t")]
    docs = docs_of(rows)
    mix = mixing.mix_sources(docs, block_words=32)
    given = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        given[r.text] += 1
    want = {}
    marks = {hashlib.md5(t.encode()).hexdigest(): t for _, t, _, _ in rows}
    taken = {(r.position, r.start): r.taken for r in mixing.words_taken(mix).select("position", "start", "taken").collect()}
    for r in mix.documents.collect():
        if r.turn == 1:
            want[marks[r.mark]] = int(taken[r.position, r.start] / r["size"] + 0.5)
    assert {t: n for t, n in want.items() if n and t != "same words here"} == {t: n for t, n in given.items() if t != "same words here"}
    assert given["same words here"] == 5 * want["same words here"]
    assert len({n for n in want.values()}) > 1


def checked(counts, room, plan):
    used = np.zeros_like(counts)
    for filling, times in plan:
        assert sum(filling) <= room and times > 0
        for size in filling:
            used[size] += times
    assert (used == counts).all()
    return sum(times for _, times in plan)


def fewest_bins(items, room):
    """Exact optimum by trying every bin for every item."""
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + items[k] <= room:
                at = bins.index(b)
                go(k + 1, bins[:at] + [b + items[k]] + bins[at + 1:])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def test_bins_against_the_optimum():
    rng = np.random.default_rng(2)
    off = 0
    for _ in range(40):
        room = int(rng.integers(6, 20))
        items = sorted(rng.integers(1, room + 1, int(rng.integers(0, 9))).tolist(), reverse=True)
        counts = np.bincount(items, minlength=room + 1) if items else np.zeros(room + 1, np.int64)
        n = checked(counts, room, pack_counts(counts, room))
        optimum = fewest_bins(items, room)
        assert least_bins(counts, room) <= optimum <= n <= checked(counts, room, best_fit(counts, room))
        off += n - optimum
    assert off == 0


def plain_fillings(counts, room):
    """Undominated fillings by trying all."""
    sizes = [s for s in range(1, room + 1) if counts[s]]
    out = set()

    def go(k, left, used):
        if k == len(sizes):
            spare = [s for s in sizes if counts[s] > used.count(s)]
            if not any(s <= left or any(0 < s - own <= left for own in used) for s in spare):
                out.add((left, tuple(sorted(used, reverse=True))))
            return
        for n in range(min(int(counts[sizes[k]]), left // sizes[k]) + 1):
            go(k + 1, left - n * sizes[k], used + [sizes[k]] * n)

    go(0, room, [])
    return out


def test_completions_are_all_undominated_fillings_by_waste():
    rng = np.random.default_rng(8)
    most = 0
    for _ in range(60):
        room = int(rng.integers(1, 18))
        counts = np.bincount(rng.integers(1, room + 1, int(rng.integers(0, 9))), minlength=room + 1)
        got = list(completions(counts, room))
        want = plain_fillings(counts, room)
        if counts[room]:
            assert got == [(room,)]
            continue
        assert [room - sum(f) for f in got] == sorted(w for w, _ in want)
        assert {(room - sum(f), f) for f in got} == want and len(got) == len(want)
        assert list(completions(counts, room, 1)) == [f for f in got if room - sum(f) <= 1]
        most = max([most, *map(len, got)])
    assert most >= 3


def test_many_short_pieces_fill_bins_whole():
    """Full bins need five to seven pieces of many sizes; no packing with fewer bins exists."""
    rng = np.random.default_rng(4)
    room, counts = 1024, np.zeros(1025, np.int64)
    for _ in range(400):
        cuts = np.sort(rng.choice(np.arange(1, 1024), int(rng.integers(4, 7)), replace=False))
        for size in np.diff([0, *cuts, 1024]):
            counts[size] += 1
    n = checked(counts, room, pack_counts(counts, room))
    assert n <= least_bins(counts, room) + 1


@pytest.mark.parametrize("text", ["", "a", "word " * 3000, "<|endoftext|> x", "a  b\n\n c", "é ß ñ 12345", "\x00\x1c\x85"])
def test_ids_equal_those_of_the_json_vocabulary(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert token_ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_fill_sequences_without_gaps(docs_of):
    texts = {1: None, 2: "", 3: "one two three", 4: "lorem ipsum " * 900, 5: "x" * 3000}
    rows = [(k, t) for k, t in texts.items()] + [(3, "one two three"), (3, "four")]
    got = packing.pack(packing.token_pieces(docs_of(rows), room=64, with_ids=True), room=64).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for key in (1, 2, 4, 5):
        parts = sorted(by_doc[key], key=lambda r: r.piece)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist()
        assert ids == [*token_ids(texts[key] or "").tolist(), 2]
        assert all(r.length == 64 for r in parts[1:])
    assert len(by_doc[3]) == 3
    assert packing.pack_documents(docs_of(rows).where("false")).count() == 0
