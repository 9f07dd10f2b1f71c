"""Operators against plain versions, exact round trips and edge rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, langid, licenses, media, ngram_join, quotes, repeats, secrets, toxicity
from plumbline.llm.queries import QUERIES, vocabulary_path

from . import brute

DOCS = "doc_id bigint, text string, lang string, score string, row bigint, n bigint"
LONG = "word " * 30_000


def frame(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in rows], DOCS)


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (4, "a b c"), (5, "A  b\tc"), (None, "null id text of some words"), (6, LONG), (7, LONG + "tail"), (8, "héllo wörld ß"), (9, "x" * 700)]


def copies(seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(4):
        base = [rnd.choice(words) for _ in range(rnd.randint(8, 80))]
        for _ in range(25):
            x = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                k = rnd.randrange(len(x))
                if rnd.random() < 0.5:
                    x[k] = rnd.choice(words)
                else:
                    x[k:k] = [rnd.choice(words)] * rnd.randint(1, 6)
            out.append((100 + len(out) * 7 % 1009, " ".join(x)))
    return out


@pytest.mark.parametrize(("short", "tile", "share"), [(24, 1024, 20_000), (1, 5, 1), (24, 5, 200)])
def test_ngram_join(spark, monkeypatch, short, tile, share):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "TILE_CLASSES", tile)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", share)
    rows = copies() + EDGE + [(None, t) for _, t in copies()[::9]] + [(None, "some other words of no id at all"), (None, None)]
    got = ngram_join.link_documents(frame(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.components(rows)))


def twins():
    """Two words of 1,024 letters that are one to polynomial hashes modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_different_long_words_differ(spark):
    a, b = twins()
    rows = [(1, f"{a} two three four five"), (2, f"{b} two three four five"), (3, a[:64] + "x"), (4, a[:64] + "y")]
    assert {r.n_links for r in ngram_join.link_documents(frame(spark, rows)).collect()} == {0}
    found = decontaminate.find_contamination(frame(spark, rows), spark.createDataFrame([(1, a), (2, a[:64] + "x")], "item_id bigint, text string")).collect()
    assert {r.doc_id: r.n_hit for r in found} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_ngram_join_empty(spark):
    assert ngram_join.link_documents(frame(spark, []).limit(0)).count() == 0
    assert ngram_join.link_documents(frame(spark, [(None, "a b"), (None, "a b")])).select("n_links").distinct().first()[0] == 1


@pytest.mark.parametrize(("most", "share"), [(512, 20_000), (3, 50)])
def test_repeats(spark, monkeypatch, most, share):
    monkeypatch.setattr(repeats, "HOT_SHARE", share)
    rnd = random.Random(6)
    bits = ["".join(rnd.choice("abc d") for _ in range(rnd.randint(20, 120))) for _ in range(30)]
    rows = [(i + 50, "".join(rnd.choice(bits) if rnd.random() < 0.8 else rnd.choice("éxyz") * rnd.randint(1, 30) for _ in range(rnd.randint(0, 12)))) for i in range(120)]
    rows += [r for r in EDGE if r[1] is None or len(r[1]) < 5000] + [(20, "ab" * 300)]
    got = repeats.remove_repeats(frame(spark, rows), max_group=most).drop("spans").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.repeats(rows)))


def test_repeat_groups_list_all_occurrences(spark):
    rnd = random.Random(1)
    shared = "".join(rnd.choice("abcdefgh") for _ in range(260))
    rows = [(i, f"{i}{chr(97 + i) * 9}{shared}{chr(110 + i) * 9}{i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "row bigint, text string").withColumn("row", F.col("row").cast("string").cast("binary"))
    found = repeats.find_repeats(docs).withColumn("row", F.col("row").cast("string").cast("bigint"))
    groups = found.groupBy("repeat").agg(F.collect_set("row").alias("rows"), F.collect_set(F.col("end") - F.col("start")).alias("n")).collect()
    assert any(len(g.rows) == 4 and len(g.n) == 1 and g.n[0] >= 200 for g in groups)
    reach = found.groupBy("row").agg(F.min("start").alias("a"), F.max("end").alias("z")).collect()
    assert {(r.a, r.z) for r in reach} == {(10, 270)}
    alike = docs.withColumn("text", F.lit(shared[:205])).unionByName(docs.withColumn("text", F.lit("x" + shared[:204])))
    groups = repeats.find_repeats(alike.withColumn("row", F.concat("row", F.left("text", F.lit(1)).cast("binary")))).groupBy("repeat").agg(F.countDistinct("row").alias("n"), F.countDistinct(F.col("end") - F.col("start")).alias("sizes"))
    assert groups.where("n = 8 and sizes = 1").count()
    assert repeats.find_repeats(docs.limit(0)).count() == 0


def test_maximal_repeats_like_brute_force():
    """All groups of contexts that share bytes round the anchor and go on differently on either side."""
    rnd = random.Random(9)
    for _ in range(60):
        left = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))).encode() for _ in range(rnd.randint(2, 9))]
        right = ["".join(rnd.choice("ab") for _ in range(rnd.randint(2, 6))).encode() for _ in left]
        want = set()
        for i in range(len(left)):
            for r in range(len(left[i]) + 1):
                for d in range(len(right[i]) + 1):
                    group = [k for k in range(len(left)) if left[k][:r] == left[i][:r] and len(left[k]) >= r and right[k][:d] == right[i][:d] and len(right[k]) >= d]
                    more_left = len({left[k][: r + 1] for k in group}) == 1 and all(len(left[k]) > r for k in group)
                    more_right = len({right[k][: d + 1] for k in group}) == 1 and all(len(right[k]) > d for k in group)
                    if len(group) > 1 and r + d >= 4 and not more_left and not more_right:
                        want.add((r, d, tuple(sorted(group))))
        got = [(int(r), int(d), tuple(sorted(m.tolist()))) for r, d, m in repeats.maximal_repeats(left, right, 4)]
        assert len(got) == len(set(got))
        assert set(got) == want


def test_intervals():
    lcp = np.array([0, 2, 3, 1, 0])
    assert sorted(repeats.intervals(lcp)) == [(0, 0, 4), (1, 0, 3), (2, 0, 2), (3, 1, 2)]


def test_bpe_like_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzéß 'sΣσς日本½²\x85\x1c\x00🙂!?\n"
    rows = EDGE[:-1] + [(100 + i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80)))) for i in range(300)] + [(99, "<|endoftext|>It's<|startoftext|>"), (98, "a" * 3000)]
    got = sorted(map(repr, map(tuple, bpe.round_trip(frame(spark, rows), path).collect())))
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert got == sorted(map(repr, want))
    coded = bpe.decode(bpe.encode(frame(spark, rows[:5]), path), path)
    assert {"ids", "decoded", "score"} <= set(coded.columns)
    assert coded.count() == 5
    once = bpe.encode(frame(spark, rows[:5]), path, "decoded").select(coded.columns)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, coded.collect()))


def test_bpe_whole_vocabulary():
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.WordBPE(path)
    words = [w.removesuffix("</w>") for w in library.get_vocab()][::7]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(words)] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


@pytest.mark.parametrize("bound", [decontaminate.ROUND_WORDS, 60])
def test_decontamination(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "ROUND_WORDS", bound)
    rnd = random.Random(2)
    words = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(12)] + [(50, None), (51, "t1"), (52, "T1!")]
    rows = EDGE[:8] + [(100 + i, " ".join([rnd.choice(words) for _ in range(rnd.randint(0, 60))] + (items[i % 12][1].upper().split() if i % 3 else []))) for i in range(80)]
    found = decontaminate.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    got = sorted(repr(tuple(r)) for r in decontaminate.digest(found).drop("n_near").collect())
    assert got == sorted(map(repr, brute.contamination(rows, items)))


def test_decontamination_empty(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    out = decontaminate.find_contamination(frame(spark, EDGE), items)
    assert out.where("contaminated").count() == 0
    assert out.count() == len(EDGE)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    rows = [(1, "gamma x alpha y beta"), (2, "alpha " + "z " * 50 + "beta gamma"), (3, "alpha beta gamma")]
    got = {r.doc_id: (r.n_near, r.n_hit) for r in decontaminate.find_contamination(frame(spark, rows), items).collect()}
    assert got == {1: (1, 0), 2: (0, 0), 3: (1, 3)}
    items = spark.createDataFrame([(1, "zeta zeta zeta eta theta")], "item_id bigint, text string")
    rows = [(1, "zeta"), (2, "zeta zeta zeta"), (3, "theta zeta x eta")]
    assert {r.doc_id: r.n_near for r in decontaminate.find_contamination(frame(spark, rows), items).collect()} == {1: 0, 2: 0, 3: 1}


def test_tiff_codecs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 576, 5000, 70_000):
        for top in (2, 5, 256):
            data = bytes(rng.integers(0, top, n, dtype=np.uint8))
            assert media.unpack_bits(media.pack_bits(data), n) == data
            assert media.lzw_decode(media.lzw_encode(data), n) == data


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("layout", [{}, {"rows": 7}, {"tile": (48, 16)}])
def test_tiff_pages(spark, order, layout):
    rng = np.random.default_rng(2)
    pages = [{"image": rng.integers(0, 9, (33, 61, c), dtype=np.uint8), "compression": k, "predictor": p, **layout} for c in (1, 3) for k in (media.NONE, media.LZW, media.DEFLATE, media.PACKBITS) for p in (1, 2)]
    data = media.write_pages(pages, order)
    files = spark.createDataFrame([(1, bytearray(data), 5), (2, None, 6), (3, bytearray(b"junk"), 7), (4, bytearray(data[:60]), 8)], "id int, media binary, width int")
    rows = media.pages(files).orderBy("id", "page").collect()
    assert [bytes(r.samples) for r in rows if r.id == 1] == [p["image"].tobytes() for p in pages]
    assert {r.id for r in rows if r.error} == {3, 4}
    assert not [r for r in rows if r.id == 2]


def test_media_round_trip(spark):
    rows = EDGE + [(30, "z" * 576), (31, "z" * 577), (32, "ab\n" * 40_000)]
    got = {(r.doc_id, r.n_bytes): r for r in media.store_and_read(frame(spark, rows)).collect()}
    for d, t in rows:
        data = (t or "").encode()
        data_ = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[d, len(data)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data_), brute.sha(data_), zlib.crc32(data_[-32:]))


def test_licenses(spark):
    rows = EDGE[:8] + [(20, "Released under the MIT License."), (21, "cc-BY and CC by; apache-license"), (22, "mit\nlicense"), (23, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation files"), (24, "CC BY" * 3)]
    got = {(r.doc_id): r for r in licenses.scan(frame(spark, rows)).collect()}
    for d, t in rows:
        w = brute.alnum_words(t)
        at = sorted(i for p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0] if at else None, at[-1] if at else None)
    assert got[23].labels == "mit-notice"
    assert 0.8 <= got[23].score < 1
    assert got[20].labels == "mit,mit-release"
    notice = licenses.TEMPLATES["gpl-notice"].split()
    wrapped = "\n".join(" ".join(notice[i : i + 5]) for i in range(0, len(notice), 5))
    other = [(1, "x " * 45 + wrapped), (2, "Released under the Apache License"), (3, "you should have received a copy of the GNU General Public License along with this program"), (4, "\u212aind under any license")]
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, other)).collect()}
    assert got == {1: "gpl,gpl-notice", 2: "apache", 3: "gpl", 4: ""}
    assert licenses.scan(frame(spark, EDGE).limit(0)).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there, how are you?\nSecond line of mine."),
        (1, 1, "assistant", "> Hello there,   how are YOU?\nFine."),
        (1, 2, "user", "> > Second line of mine.\n> Fine.\nGood to hear"),
        (1, 3, "user", "> nobody said this\n>\n> Second line of mine."),
        (2, 0, None, None),
        (2, 1, "user", "> Good to hear\nfrom another conversation"),
        (2, 1, "user", "> Good to hear\nfrom another conversation"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, level int")
    got = {(r.conv_id, r.turn): r for r in quotes.reply_order(df).collect()}
    assert (got[1, 1].reply_to, got[1, 1].body, got[1, 1].n_linked) == (0, "Fine.", 1)
    assert (got[1, 2].reply_to, got[1, 2].max_level, got[1, 2].n_linked, got[1, 2].thread) == (1, 2, 2, 0)
    assert (got[1, 3].n_passages, got[1, 3].n_linked, got[1, 3].reply_to) == (2, 1, 0)
    assert (got[2, 1].n_linked, got[2, 1].reply_to) == (1, None)
    assert quotes.reply_order(df).count() == len(rows)
    assert quotes.conversations(df).where("conv_id = 1").first().chat.startswith("user: Hello there")
    assert quotes.reply_order(df.limit(0)).count() == 0


def test_toxicity_needs_pairs():
    """A label that is the product of two terms is beyond a linear model."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 6))
    y = (x[:, 0] & x[:, 1]) | (1 - x[:, 0]) & (1 - x[:, 1])
    b, w, f = toxicity.train([np.flatnonzero(r) for r in x], y, 6, steps=600)
    m = toxicity.Machine(np.arange(6), b, w, f)
    rows, cols = np.nonzero(x)
    assert (((m.score(len(x), rows, cols) > 0.5) == y).mean()) > 0.95


def test_toxicity_learns_terms_that_matter_only_jointly(spark):
    """Neither of two terms tells the classes apart by itself; both, or one without the other, do."""
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        words = [f"v{rnd.randint(0, 400)}" for _ in range(20)]
        for there, w in ((a, "they"), (b, "filthy")):
            words[rnd.randrange(20):0] = [w] if there else []
        rows.append((i, " ".join(words)))
        labels.append((i, int(a == b)))
    got = toxicity.judge(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).where("held_out").collect()
    assert len(got) > 200
    assert np.mean([(r.score > 0.5) == labels[r.doc_id][1] for r in got]) > 0.95


def test_machine_like_all_pairs():
    """The score is that of the sum over all pairs, written out."""
    rng = np.random.default_rng(6)
    m = toxicity.Machine(np.arange(9), 0.3, rng.normal(0, 1, 9), rng.normal(0, 1, (9, 3)))
    x = rng.integers(0, 2, (20, 9))
    rows, cols = np.nonzero(x)
    z = [0.3 + sum(m.weights[i] for i in f) + sum(m.factors[i] @ m.factors[j] for i in f for j in f if i < j) for f in map(np.flatnonzero, x)]
    assert np.allclose(m.score(20, np.tile(rows, 2), np.tile(cols, 2)), 1 / (1 + np.exp(-np.array(z))))


def test_toxicity_sample_is_bounded_where_an_id_stands_on_many_rows(spark, monkeypatch):
    rows = [(0, f"text {k % 7} of the many") for k in range(3000)] + [(k, f"text {k} alone") for k in range(1, 60)]
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(60)], "doc_id bigint, toxic int")
    seen = []

    def keep(df, name):
        out = df.persist()
        seen.extend([out] if name == "sample" else [])
        return out

    monkeypatch.setattr(toxicity, "materialize", keep)
    machine = toxicity.fit(frame(spark, rows), labels, sample_rows=40)
    assert seen[0].count() == 40
    assert toxicity.score(frame(spark, rows), machine).count() == len(rows)


def test_toxicity_held_out(spark):
    rnd = random.Random(4)
    rows, labels = list(EDGE), [(None, 1), (4, None), (77_777, 1)]
    for i in range(1000, 1600):
        bad = i % 7 == 0
        rows.append((i, " ".join([f"v{rnd.randint(0, 400)}" for _ in range(40)] + ["insult"] * bad)))
        labels.append((i, int(bad)))
    got = toxicity.judge(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and (r.doc_id or 0) >= 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert all(r.predicted == (r.doc_id % 7 == 0) for r in held)
    none = toxicity.judge(frame(spark, EDGE), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert none.where("predicted = 1").count() == 0


def test_language(spark):
    rnd = random.Random(5)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["ßü", "äch", "pf"], "cc": ["ción", "es", "ña"]}
    rows = [(i, " ".join("".join(rnd.choice(sounds[l]) for _ in range(3)) for _ in range(30)), l) for i in range(300) for l in [("aa", "bb", "cc")[i % 3]]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 !?", "bb"), (903, "kaloomi", None), (None, "kalo", "aa")]
    got = langid.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].lang_pred == l for i, _, l in rows[:300])
    assert {by[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.judge(spark.createDataFrame(rows[:3], "doc_id bigint, text string, lang string").withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().first()[0] == "und"


def test_language_like_a_plain_version(spark):
    """Predictions against the definition, word by word; the texts beside a text change no digit of its score."""
    rnd = random.Random(15)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["ßü", "mi", "pf"]}
    rows = [(i, " ".join("".join(rnd.choice(sounds[l]) for _ in range(rnd.randint(1, 3))) for _ in range(12)), l) for i in range(120) for l in [("aa", "bb")[i % 2]]]
    rows += [(500, "zzz kalopf", None), (500, "zzz kalopf", None), (501, None, "aa"), (502, "ka " * 20_000 + "!", None)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, text string, lang string, lang_pred string, score double")
    counts = {}
    for d, t, l in rows:
        if t and l and zlib.crc32(str(d).encode()) % 5:
            for w in t.split():
                for n, g in [(0, w), *((n, f" {w} "[i : i + n]) for n in range(1, 5) for i in range(len(w) + 3 - n))]:
                    counts.setdefault(n, {}).setdefault(g, {}).setdefault(l, 0)
                    counts[n][g][l] += 1
    total = {n: {l: sum(v.get(l, 0) for v in c.values()) for l in ("aa", "bb")} for n, c in counts.items()}
    known = {n: {g: v for g, v in c.items() if sum(v.values()) >= 2} for n, c in counts.items()}
    value = lambda n, g: np.array([np.log((known[n][g].get(l, 0) + 0.1) / (total[n][l] + 0.1 * langid.KEEP)) for l in ("aa", "bb")])

    def plain(text):
        z, words = np.zeros(2), re.findall(r"[^\W\d_]+", (text or "").lower())
        for w in words:
            if w in known[0]:
                z += value(0, w)
                continue
            p, found = f" {w} ", []
            for i in range(len(p)):
                g = next((p[i : i + n] for n in range(4, 0, -1) if i + n <= len(p) and p[i : i + n] in known[n]), None)
                found += [value(len(g), g)] if g else []
            z += sum(found) / len(found) if found else 0
        p = np.exp(z / np.sqrt(len(words)) - (z / np.sqrt(len(words))).max()) if words else None
        return ("und", 0.0) if p is None else (("aa", "bb")[int(p.argmax())], p.max() / p.sum())

    got = langid.judge(docs).collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t, _ in rows}
    for r in got:
        lang, score = plain(texts[r.doc_id])
        assert r.lang_pred == lang
        assert abs(r.score - score) < 1e-9
    assert len({r.score for r in got if r.doc_id == 500}) == 1
    again = {r.doc_id: r.score for r in langid.judge(docs.repartition(7)).collect()}
    assert all(again[r.doc_id] == r.score for r in got)
    assert langid.judge(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op2_quotation_linking", "quoting_replies"])
def test_quotes_like_sql(spark, name):
    import duckdb

    from plumbline.llm.queries import SQL

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, folder).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
    assert (sum(r.n_linked for r in got) > 0) == (name == "quoting_replies")


def test_quotes_link_to_other_conversations(spark):
    """Where the least offer is of the quoting conversation, but later, another conversation's counts."""
    rows = [(1, 1, "u", "> said it all\nyes"), (1, 2, "u", "said it all"), (2, 1, "u", "said it all"), (3, 1, "u", "x " * 50_000)]
    _, passages = quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert [(r.from_conv, r.from_turn) for r in passages.collect()] == [(2, 1)]


def plain_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x[2] for x in sorted(out)]


def test_secrets(spark):
    rnd = random.Random(7)
    pieces = ["password=", "TOKEN : ", 'api_key = "', "secret: token: abcdefg", "AKIA", "é ", "hello world ", "ſecret=abcdefgh "]
    tails = ["".join(rnd.choice("0123456789abcdef") for _ in range(n)) for n in (5, 18, 24, 40)] + ["ABCDEFGHIJKLMNOP", "x y"]
    rows = EDGE + [(100 + i, "\n".join("".join(rnd.choice(pieces) + rnd.choice(tails) for _ in range(3)) for _ in range(4))) for i in range(60)]
    got = secrets.digest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {d: plain_spans(t or "") for d, t in rows}
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("crf")]
        assert base == want[r.doc_id]
        assert r.base_sha256 == brute.sha(",".join(base).encode())
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
    clean = secrets.redact(frame(spark, rows), secrets.fit(frame(spark, rows)))
    assert clean.columns == frame(spark, []).columns
    assert not any(plain_spans(r.text or "") for r in clean.collect() if (r.doc_id or 0) >= 100 and "[SECRET]" not in r.text)
    assert secrets.digest(frame(spark, [(1, None), (2, "")])).where("spans <> ''").count() == 0


def test_secret_training_takes_distinct_lines(spark, monkeypatch):
    rows = [(i, "password=aaaaaaaa\nthe same line") for i in range(1500)] + [(2000 + i, f"password=abc{i:05d}\nplain line {i}") for i in range(40)]
    seen = []

    def keep(df, name):
        out = df.persist()
        seen.extend([out] if name == "windows" else [])
        return out

    monkeypatch.setattr(secrets, "materialize", keep)
    assert secrets.fit(frame(spark, rows)) is not None
    lines = [r.h for r in seen[0].collect()]
    assert len(lines) == len({*lines}) == 82


def test_secret_training_sees_whole_documents(spark):
    rnd = random.Random(2)
    key = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"number {i}: 1234567890\n" * 20 + "plain words " * 500 + f'token = "{key()}" ' + "more words " * 500) for i in range(30)]
    windows = secrets.training_windows(frame(spark, rows)).collect()
    seen = {row.tobytes() for _, t in rows for row in secrets._labelled(t)[1].astype(np.int32)}
    width = 4 * len(secrets.GROUPS)
    assert all(r.x[k : k + width] in seen for r in windows for k in range(0, len(r.x), width))
    assert sum(secrets.BEGIN in r.y for r in windows) >= 30
    assert secrets.fit(frame(spark, rows)) is not None  # every secret is in a line of more than 4,000 characters


def test_likelihood_like_enumeration():
    """The loss is that of all paths, and its gradient that of small steps."""
    from itertools import product

    rng = np.random.default_rng(5)
    lines = [(rng.integers(0, 12, (n, len(secrets.GROUPS))), rng.integers(0, 3, n)) for n in (1, 4, 6)]
    used, loss = secrets.likelihood(lines, 0.01)
    x = rng.normal(0, 1, 3 * len(used) + 9)
    w, m = np.zeros((12, 3)), x[-9:].reshape(3, 3)
    w[used] = x[:-9].reshape(-1, 3)

    def path(f, y):
        return sum(w[f[i], v].sum() for i, v in enumerate(y)) + sum(m[a, b] for a, b in zip(y, y[1:], strict=False))

    want = sum(np.log(sum(np.exp(path(f, z)) for z in product(range(3), repeat=len(y)))) - path(f, y) for f, y in lines) / 3 + 0.005 * x @ x
    value, grad = loss(x)
    assert abs(value - want) < 1e-9
    for k in range(len(x)):
        step = np.zeros(len(x))
        step[k] = 1e-5
        assert abs((loss(x + step)[0] - loss(x - step)[0]) / 2e-5 - grad[k]) < 1e-6


def test_spans_that_touch_base_spans_are_left_out():
    rng = np.random.default_rng(8)
    for _ in range(200):
        base, docs, starts, ends = [], [], [], []
        for doc in range(3):
            at = np.sort(rng.integers(0, 60, (rng.integers(0, 6), 2)), 1)
            base.append(sorted((int(a), int(rng.integers(0, 3)), "hex", int(z) + 1) for a, z in at))
            edges = np.unique(rng.integers(0, 60, 8))
            for a, z in zip(edges[::2], edges[1::2]):
                docs.append(doc), starts.append(a), ends.append(z)
        got = list(secrets._apart(np.array(docs, int), np.array(starts, int), np.array(ends, int), base))
        assert got == [(d, a, z) for d, a, z in zip(docs, starts, ends) if all(z <= x or y <= a for x, _, _, y in base[d])]


def test_many_spans_in_one_text_take_linear_time():
    text = " ".join(f"x{k} é token={k:08d}" for k in range(16_000))
    field = secrets.Field(np.zeros((secrets.N_FEATURES, 3)), np.zeros((3, 3)))
    field.weights[:, secrets.BEGIN] = 1.0  # every token begins a span
    began = time.process_time()
    (_, _, _, (found,)), = secrets._located(pa.record_batch({"text": [text]}), field)
    assert time.process_time() - began < 5
    assert sum(k == "assign" for _, _, k, _ in found) == 16_000
    for a, _, k, z in found[:: len(found) // 50]:
        assert k == "assign" or text[a:z].strip() == text[a:z] != ""


def test_field_finds_secrets_that_the_patterns_miss(spark):
    rnd = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    planted = {}
    for k in rnd.sample([i for i, r in enumerate(rows) if len(r[1]) > 200], 80):
        words = rows[k][1].split(" ")
        at = rnd.randrange(len(words))
        head = " ".join(words[:at]) + (" Authorization: Bearer " if k % 2 else " client_key = ")
        value = "".join(rnd.choice(letters) for _ in range(36))
        assert not plain_spans(value)
        planted[rows[k][0]] = (len(head), len(head) + len(value))
        rows[k] = (rows[k][0], head + value + " " + " ".join(words[at:]))
    docs = frame(spark, rows)
    spans = [(r.doc_id, s.start, s.end) for r in secrets.find(docs, secrets.fit(docs)).collect() for s in r.spans if s.kind == "crf"]
    right = [d for d, a, z in spans if d in planted and a < planted[d][1] and planted[d][0] < z]
    assert len(set(right)) >= 0.7 * len(planted)
    assert len(right) >= 0.95 * len(spans)


def test_viterbi_is_exact():
    """Runs between certain tokens give the same labels as the best of all paths."""
    from itertools import product

    rng = np.random.default_rng(3)
    field = secrets.Field(rng.normal(0, 3, (50, 3)), rng.normal(0, 1, (3, 3)))
    features = rng.integers(0, 50, (40, 2))
    text = np.repeat([0, 1, 2, 3, 4], 8)
    got = field.decode(features, text)
    scores = field.weights[features].sum(1)
    for k in range(5):
        s = scores[text == k]
        best = max(product(range(3), repeat=8), key=lambda y: sum(s[i, v] for i, v in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert tuple(got[text == k]) == best


def test_every_operator_is_registered():
    assert sorted(int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for name, stage in p.STAGES[:-1]:
        before = docs.count()
        docs = p.materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == columns
        assert 0.7 * before <= docs.count() <= before
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {d for d, _ in rows} <= ids
    linked = {d: c for d, _, c, _ in brute.components(rows)}
    assert all(d == c for d, c in linked.items())
    out = p.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert len(out) == len(rows)
    assert all(r.n_tokens == len(r.ids) for r in out)


CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, spans string, row bigint, ids string, contaminated boolean"


@pytest.mark.parametrize("rows", [[], EDGE])
def test_pipeline_stages_on_edge_rows(spark, rows):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), "kept", "kept", 1, "kept", None) for i, t in rows] + [(i, f"plain words number {i} and password=abc{i:05d}", None, "s", 1, "kept", "kept", 1, "kept", True) for i in range(100, 130 if rows else 100)], CLASHING)
    for name, stage in p.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name == "tokens":
            assert out.count() == docs.count()
            continue
        assert out.columns == docs.columns
        out = out.collect()
        assert all(r.score == r.spans == r.ids == "kept" for r in out)
        if name == "near_duplicates":
            assert len(out) == (docs.count() and docs.count() - 2)  # of the two rows of 4 and that of 5 one stays
            if rows:
                assert [(r.doc_id, r.text) for r in out if r.doc_id in (4, 5)] == [(4, "a b c")]
        else:
            assert len(out) == docs.count()
        if name == "secrets":
            assert all("[SECRET]" in r.text for r in out if (r.doc_id or 0) >= 100)


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Where a doc_id stands on several rows no group is lost: against all pairs of rows."""
    import corpus_pipeline as p

    rng = random.Random(8)
    rows = [(rng.choice([None, i, i % 12, i % 7]), t) for i, (_, t) in enumerate(copies(9))]
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows += [(5, a), (7, a), (5, b), (3, b), (900, None), (901, ""), (902, "")]
    docs = frame(spark, rows)
    got = sorted(map(repr, ((r.doc_id, r.text) for r in p.keep_one_of_each_group(spark, docs, "").collect())))
    linked = {i: c for i, _, c, _ in brute.components([(i, t) for i, (_, t) in enumerate(rows)])}
    groups = {}
    for i, c in linked.items():
        if rows[i][0] is not None:
            groups.setdefault(c, []).append(rows[i])
    assert len(got) == len(groups) + sum(i is None for i, _ in rows)
    kept = [r for r in rows if r[0] is None and repr(r) in got]
    assert len(kept) == sum(i is None for i, _ in rows)
    for members in groups.values():
        least = min(i for i, _ in members)
        assert any(repr(r) in got for r in members if r[0] == least)
