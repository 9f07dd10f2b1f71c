"""Spelling variants, the Merkle manifest and byte-level tokens against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import bytebpe, merkle, spelling

ROWS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, place bigint, word string, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x", "x") for r in rows], ROWS)


def documents(pairs):
    return [(i, "s", "en", 1, t) for i, t in pairs]


# --- spelling variants


def plain_variants(rows):
    import re
    from collections import Counter, defaultdict

    n = Counter()
    for doc_id, *_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    of = defaultdict(list)
    for a in n:
        of[a] = [b for b in n if b != a and abs(len(a) - len(b)) < 2 and near(a, b)]
    form = {}
    for a, others in of.items():
        best = min(others, key=lambda b: (-n[b], b), default=None)
        form[a] = best if best and n[best] >= 2 * n[a] else None
    out = []
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        out.append((a, form[a], root, n[a], len(of[a]), n[form[a]] if form[a] else None))
    return out


def misspelt(seed, words=60, texts=400):
    rng = random.Random(seed)
    known = ["".join(rng.choices("abcdeéÀß", k=rng.randint(4, 9))) for _ in range(words)]

    def one():
        w = list(rng.choice(known[: rng.randint(1, words)]))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1])] = rng.choice(["", "a", "é", "A", "ab"])
        return "".join(w)

    return [(rng.choice([None, i]), " ".join(one() for _ in range(rng.randint(0, 40)))) for i in range(texts)]


@pytest.mark.parametrize(("shard", "slot", "leaf"), [(20_000, 60_000, 8), (40, 25, 1)])
def test_spelling_variants(spark, monkeypatch, shard, slot, leaf):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "SLOT_WORDS", slot)
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    long = "abcde" * 4000
    rows = documents([*misspelt(3), (1, None), (2, ""), (3, " 123 "), *[(7, f"{long} {long}x {long}")] * 3, (8, "chain " * 3 + "chains " * 6 + "chainse " * 12 + "tied1 aaaaab aaaaac aaaaad")])
    rows += documents([(50 + i, "aaaaab aaaaac") for i in range(9)])
    got = [tuple(r) for r in spelling.variants(frame(spark, rows)).collect()]
    want = plain_variants(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(f and r != f for _, f, r, *_ in want)  # a chain of forms


def test_search_reaches_all_near_words():
    """The trie's candidates hold every pair of vectors within the budget, and shards lose none."""
    rng = np.random.default_rng(5)
    trie = np.unique(rng.integers(0, 3, (600, len(spelling.GROUPS))) * (rng.random((600, len(spelling.GROUPS))) < 0.1), axis=0).astype(np.int32)
    asked = np.clip(trie[rng.integers(0, len(trie), 300)] + rng.integers(-1, 2, (300, trie.shape[1])) * (rng.random((300, trie.shape[1])) < 0.04), 0, 9).astype(np.int32)
    over = asked[:, None, :] - trie[None]
    want = {(int(a), int(b)) for a, b in np.argwhere((np.maximum(over, 0).sum(2) <= 1) & (np.maximum(-over, 0).sum(2) <= 1))}
    assert {(int(q), leaf) for leaf, rows in spelling.candidates(trie, asked) for q in rows} == want
    cuts = list(range(0, len(trie), 37))
    lows, highs = trie[cuts], trie[[min(c + 37, len(trie)) - 1 for c in cuts]]
    sent = {(int(q), s) for s, rows in spelling.reached(asked, lows, highs) for q in rows}
    assert {(q, t // 37) for q, t in want} <= sent


def test_spelling_without_words(spark):
    assert spelling.variants(frame(spark, [])).collect() == []
    assert spelling.variants(frame(spark, documents([(1, "few words"), (2, None)]))).collect() == []


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            path.append((i % 2 == 1, level[i ^ 1] if i ^ 1 < len(level) else None))
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((own, *plain_tree([leaf_of(r) for r in own])))
    root, above = plain_tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, paths), rest in zip(trees, above, strict=True):
        for row, path in zip(own, paths, strict=True):
            changed = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            h = leaf_of((*row[:3], row[3] + 1, row[4]) if changed else row)
            for left, sibling in path + rest:
                h = sha(sibling + h if left else h + (sibling or ""))
            out.append((row[0], leaf_of(row), subroot, root, sha("".join(s for _, s in path + rest if s)), h, h == root))
    return out


def leaf_rows(n, langs, seed):
    rng = random.Random(seed)
    return [(rng.choice([None, i, i, i % 50]), rng.choice([None, "s"]), rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", "é x", f"t{i}", "long " * 9000])) for i in range(n)]


MANIFESTS = {
    "empty": [],
    "one": leaf_rows(1, ["a"], 1),
    "null language": leaf_rows(2, [None], 2),
    "uneven": leaf_rows(300, [*["a"] * 20, None, "ü", *(f"l{i}" for i in range(21))], 3),
    "a language each": [(i, "s", f"{i}", 1, "t") for i in range(40)],
    "equal rows": [(1, "s", "a", 3, "t")] * 9,
}


@pytest.mark.parametrize("group", [(12, 4), (2, 1)])
@pytest.mark.parametrize("case", MANIFESTS)
def test_manifest(spark, monkeypatch, case, group):
    monkeypatch.setattr(merkle, "GROUP_LEVELS", group[0])
    monkeypatch.setattr(merkle, "LINK_LEVELS", group[1])
    rows = MANIFESTS[case]
    got = [tuple(r) for r in merkle.verify(frame(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(rows)))


# --- byte-level tokens


@pytest.fixture(scope="module")
def bytes_path():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def model(bytes_path):
    return bytebpe.ByteBPE(bytes_path, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(model):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_all_letters(model, library):
    texts = [f"a{chr(c)}a {chr(c)}1 {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0 or 0x10000 <= c < 0x20000)]
    for k in range(0, len(texts), 5000):
        part = texts[k : k + 5000]
        assert [ids(x) for x in model.encode(part)] == [library.encode_ordinary(t) for t in part]


@pytest.mark.parametrize("exact", [False, True])
def test_mixed_texts(model, library, monkeypatch, exact):
    monkeypatch.setattr(model, "in_order", not exact)
    monkeypatch.setattr(model, "pairs", {})
    monkeypatch.setattr(model, "memory", {})
    monkeypatch.setattr(model, "older", {})
    monkeypatch.setattr(bytebpe, "MEMORY_BYTES", 50_000)
    rng = random.Random(4)
    parts = ["the", "ing", " ", "\n", "é", "ß", "漢", "字", "ا", "12", "<|endoftext|>", "'s", "  ", "\t", "\x1c", "\x85", "q", "Ω", "о", "\U00018da7", "՘"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)] + ["".join(rng.choices("etaoinsrh", k=rng.randint(1, 80))) for _ in range(3000)]
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        assert [ids(x) for x in model.encode(part)] == [library.encode_ordinary(t) for t in part]


def test_tokens_that_merging_never_makes(tmp_path, library):
    """A token that is in the way of its own parts: only the whole piece is taken as it."""
    import base64

    own = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 258, b"cd": 259, b"abcd": 260, b"xyz": 261}
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in own.items()))
    made = bytebpe.ByteBPE(str(path), public_tokenizers.PATTERN)
    assert not made.in_order
    other = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdxyz ", k=rng.randint(1, 30))) for _ in range(2000)]
    assert [ids(x) for x in made.encode(texts)] == [other.encode_ordinary(t) for t in texts]


def test_long_pieces(model, library):
    for text in ("ab" * 100_000, "z" * 50_000, " " * 50_000, "".join(random.Random(2).choices("etaoinsrh", k=100_000))):
        assert ids(model.encode([text])[0]) == library.encode_ordinary(text)


def test_round_trip(spark, bytes_path, library):
    rows = documents([(1, None), (2, ""), (None, "no id"), (3, "tie"), (3, "tie"), (4, "word " * 50_000), (5, "漢字 é <|endoftext|>")])
    got = sorted(map(repr, map(tuple, bytebpe.round_trip(frame(spark, rows), bytes_path, public_tokenizers.PATTERN).collect())))

    def want(i, text):
        coded = library.encode_ordinary(text or "")
        return i, len(coded), hashlib.sha256(np.array(coded, "<u4").tobytes()).hexdigest(), sha(text or "")

    assert got == sorted(repr(want(r[0], r[4])) for r in rows)
    coded = bytebpe.encode(frame(spark, rows), bytes_path, public_tokenizers.PATTERN)
    back = bytebpe.decode(coded, bytes_path, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.word == "x" for r in back)
    assert bytebpe.round_trip(frame(spark, []), bytes_path, public_tokenizers.PATTERN).collect() == []
