import random
import re
from hashlib import md5, sha256
from zlib import crc32

import pytest

from riskloom.llm import merkle, trie

TURNS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_trie(rows):
    """Nodes as the contract states them, without hashes or bands."""
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            talks.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    talks = {c: [x for _, x in sorted(t)] for c, t in talks.items()}
    built = {}
    for c, own in talks.items():
        h = crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(talks.get(head, [])[:h] + own[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for name in members:
        if name:
            kids.setdefault(name[:-1], []).append(name)
    totals = {}
    for name in sorted(members, key=len, reverse=True):
        leaves = 0 if name in kids else 1
        saved = (len(members[name]) - 1) * len(WORD.findall(name[-1][1] if name else ""))
        for k in kids.get(name, ()):
            leaves, saved = leaves + totals[k][0], saved + totals[k][1]
        totals[name] = leaves, saved
    return sorted((
        min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, ())), *totals[n],
        sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)).encode()).hexdigest(),
    ) for n, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    return sorted(tuple(r) for r in trie.conversation_trie(df).select(COLUMNS).collect())


def test_trie_of_hard_rows(spark):
    rows = [
        (0, 1, "user", "a b"), (0, 0, "user", "x"), (0, None, None, None), (0, 2, "assistant", "longer words here"),
        (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 5, "user", ""), (21, 0, None, "b c d"), (-7, 0, "u", "neg"), (-20, 0, "u", "neg"),
        (None, 0, "user", "lost"), (40, 0, "user", "q " * 20_000), (41, 3, "user", "q " * 20_000),
    ] + [(60 + k, t, "user", f"same {t}") for k in range(25) for t in range(6)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as depth", "'x' as a", "2 as place").repartition(3)
    assert nodes(df) == plain_trie(rows)


def test_empty_table_has_no_node(spark):
    assert nodes(spark.createDataFrame([], TURNS)) == []


def test_deep_conversations_in_small_bands(spark, monkeypatch):
    monkeypatch.setattr(trie, "BAND", 2)
    monkeypatch.setattr(trie, "RUN", 16)
    monkeypatch.setattr(trie, "LIST_ROWS", 3)
    draw = random.Random(5)
    rows = []
    for c in range(30):
        talk = "A" if c % 3 else "B"
        for t in range(draw.choice([1, 3, 17, 40, 70])):
            rows.append((c, t, "user", f"{talk} {t}" if t < 30 else f"{c} {t}"))
    assert nodes(spark.createDataFrame(rows, TURNS).repartition(4)) == plain_trie(rows)


def plain_manifest(rows):
    def digest(values):
        said = [None if v is None else str(v).encode() for v in values]
        return sha256(b"".join(b"-" if v is None else str(len(v)).encode() + b":" + v for v in said)).hexdigest()

    def lower(t):
        return t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def up(level):
        return [sha256("".join(level[i:i + 8]).encode()).hexdigest() for i in range(0, len(level), 8)]

    def proof(levels, place):
        out = []
        for level in levels[:-1]:
            first = place // 8 * 8
            out.append((level[first:place], level[place + 1:first + 8]))
            place //= 8
        return out

    def levels_of(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(up(levels[-1]))
        return levels

    full = []
    for doc_id, text, lang, source, n_chars in rows:
        leaf = digest([doc_id, source, lang, n_chars, text])
        hit = doc_id is not None and crc32(str(doc_id).encode()) % 3 == 0
        full.append((lang, doc_id, leaf, digest([doc_id, source, lang, n_chars, lower(text)]) if hit else leaf))
    langs = sorted({r[0] for r in full}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in full if r[0] == x), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for x in langs}
    levels = {x: levels_of([r[2] for r in t]) for x, t in trees.items()}
    top = levels_of([levels[x][-1][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        for place, (_, doc_id, leaf, now) in enumerate(trees[x]):
            runs = proof(levels[x], place) + proof(top, n)
            seen = sha256("".join("".join(a + b) for a, b in runs).encode()).hexdigest()
            for a, b in runs:
                now = sha256("".join([*a, now, *b]).encode()).hexdigest()
            out.append((doc_id, leaf, levels[x][-1][0], top[-1][0], seen, now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_equals_a_plain_one(spark, docs_of, height):
    rows = [(k, f"Text {k}", ("de", "en", None, "fr", "é")[k % 5 if k > 200 else 1], ("web", None)[k % 2]) for k in range(700)]
    rows += [(None, "A", "de"), (None, None, "de"), (7, "Text 7", "en", None), (7, "Text 7", "en", None), (900, "X" * 50_000, "alone"), (902, "", None), (903, None, "")]
    full = [(*r, *[None] * (4 - len(r)), None) for r in rows]
    df = merkle.merkle_manifest(docs_of(rows), height=height)
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == plain_manifest(full)


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_manifest_at_edges_of_levels(spark, docs_of, n):
    rows = [(k, f"T{k}", "en", "s") for k in range(n)]
    got = sorted((tuple(r) for r in merkle.merkle_manifest(docs_of(rows), height=1).collect()), key=str)
    assert got == plain_manifest([(*r, None) for r in rows])


def test_manifest_of_nothing(spark, docs_of):
    assert merkle.merkle_manifest(docs_of([])).collect() == []


def test_interval_difference_names_the_siblings():
    import numpy as np

    level = lambda n, w: (np.arange(0, n, w), np.minimum(np.arange(0, n, w) + w, n), [str(k) for k in range(0, n, w)])
    nodes = [level(20, 1), level(20, 8), level(20, 64)]
    steps = merkle._steps(np.array([0, 9, 19]), nodes)
    assert steps == [[(0, 0, 8, 0), (0, 0, 3, 1)], [(8, 9, 16, 0), (0, 1, 3, 1)], [(16, 19, 20, 0), (0, 2, 3, 1)]]
