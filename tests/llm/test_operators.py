"""The operators' own interfaces."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colonnade.llm import exact_dedup, fingerprints, graph, language, mixing, near_dedup, pieces, remember, token_files
from colonnade.llm.bpe import encoder
from colonnade.llm.suffix_array import common_prefixes, suffix_array
from colonnade.llm.token_counts import CountTree

from .conftest import prose


def test_phrases_inside_equal_substrings_are_equal():
    """The names inside a common substring do not depend on its offset."""
    inner = prose(1, 200).encode()
    found = []
    for before in (b"", b"x", b"some other words ", prose(2, 40).encode()):
        for k, (names, _) in enumerate(fingerprints.levels(np.frombuffer(before + inner, np.uint8), np.array([0])), 1):
            if k == 3:
                found.append(names[-40:].tolist())  # what ends the text
    assert all(f == found[0] for f in found)


def test_phrases_are_short():
    for t in (prose(3, 500).encode(), bytes(random.Random(1).choices(range(256), k=5000)), b"abab" * 900):
        names = np.frombuffer(t, np.uint8)
        for up, _ in fingerprints.levels(names, np.array([0])):
            assert len(up) <= max(1, (len(names) + 1) // 2) or len(names) < 4
            names = up


def test_likeness_follows_edits():
    t = prose(4, 400)
    f = lambda x: fingerprints.text_of(*fingerprints.sketch([x.encode()]))[0]
    a = f(t)
    near = [fingerprints.likeness_of(a, f(t[: len(t) - len(t) * k // 10] + prose(5, 400)[: len(t) * k // 10])) for k in (0, 1, 3, 6, 10)]
    assert near[0] == 1.0 and near == sorted(near, reverse=True) and near[-1] < 0.1 < near[2]


def test_nbest_against_all_paths():
    m = pieces.lattice()

    def every(text):
        edges, _ = m.edges(text)
        out = {len(text): [(0, ())]}
        paths = [(0, (), len(text), ())]
        done = []
        while paths:
            score, ids, at, widths = paths.pop()
            if not at:
                done.append((-score, widths, ids))
            for start, s, got in edges[at]:
                paths.append((score + s, ((got,) if type(got) is int else got) + ids, start, (*widths, start - at)))
        del out
        return [(-s / pieces.ONE, ids) for s, _, ids in sorted(done)]

    for text in ("▁the", "▁there", "▁aab", "▁é😀", "▁1,2", "▁", "▁ananana"):
        want = every(text)
        got = m.search(text, 8)
        assert got == want[:8], text


def test_nbest_of_texts():
    m = pieces.lattice()
    text = "The cat, the 3 dogs.\n  Über 😀"
    paths = m.nbest(text, 12)
    assert len({p[1] for p in paths}) == 12 and [p[0] for p in paths] == sorted((p[0] for p in paths), reverse=True)
    assert all(m.decode(ids) == text for _, ids in paths)
    ids, score, loss = m.encode(text)
    assert paths[0] == (score, tuple(np.frombuffer(ids, "<u4").tolist())) and paths[1][0] == pytest.approx(score - loss)
    whole = m.search(pieces.SPACE + text.replace(" ", pieces.SPACE), 12)
    assert [round(p[0], 6) for p in whole] == [round(p[0], 6) for p in paths]


def test_parts_together_as_one_by_one():
    a, b = pieces.Lattice(pieces.public_tokenizers.path(pieces.VOCABULARY)), pieces.lattice()
    texts = [prose(i, 300) for i in range(20)] + ["", None, " ", "é😀 x", "日本語 テキスト", "a" * 300, "▁▁ a▁b"]
    assert a.nbest_all(texts, 2) == [b.nbest(t, 2) for t in texts]


def test_pieces_frames(spark, corpus):
    docs = spark.read.parquet(corpus + "/documents.parquet")
    decoded = pieces.decode_pieces(pieces.encode_pieces(docs))
    want = sorted(((r.doc_id, (r.text or "").replace("▁", " ")) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert sorted(map(tuple, decoded.collect()), key=repr) == want


def test_nbest_frames(spark, corpus):
    """The n best paths of texts are what the search over the whole lattice finds, ties in its order."""
    docs = spark.read.parquet(corpus + "/documents.parquet").where("length(text) < 1000 or text is null")
    m = pieces.lattice()
    for n in (2, 5):
        for r in pieces.encode_pieces(docs, n=n, keep=("text",)).collect():
            want = m.search(pieces.SPACE + r.text.replace(" ", pieces.SPACE), n) if r.text else [(0.0, ())]
            assert [(r.score, tuple(r.ids)), *((p.score, tuple(p.ids)) for p in r.others)] == want
            assert r.second == (want[1][0] if len(want) > 1 else None)
    with pytest.raises(ValueError):
        pieces.encode_pieces(docs, n=1)


def test_many_parts_by_one_search():
    """All parts of one length together, part by part, and whole lattices give the same paths."""
    g = random.Random(9)
    texts = ["".join(g.choice(["a", "an", "na", "the", " ", "  ", "é", "😀", "1", ",", ".", "ing", "▁"]) for _ in range(g.randrange(14))) for _ in range(300)]
    for n in (1, 2, 4):
        a, b = (pieces.Lattice(pieces.public_tokenizers.path(pieces.VOCABULARY)) for _ in range(2))
        for t, got in zip(texts, a.nbest_all(texts, n), strict=True):
            assert got == b.nbest(t, n) == (b.search(pieces.SPACE + t.replace(" ", pieces.SPACE), n) if t else [(0.0, ())])


def test_forgotten_parts_change_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 300)
    monkeypatch.setattr(pieces, "REMEMBERED_IDS", 4000)
    a, b = pieces.Lattice(pieces.public_tokenizers.path(pieces.VOCABULARY)), pieces.lattice()
    for at in range(0, 40, 5):
        texts = [prose(i % 7, 60) + " " + prose(i, 60) + " z" * i for i in range(at, at + 5)]
        assert a.nbest_all(texts, 3) == [b.nbest(t, 3) for t in texts]
    assert len(a.known[3].check) < 2000 and a.known[3].filled < 40_000


def test_remembering_is_invisible():
    calls = []
    r = remember.Remembered(lambda k: calls.append(k) or len(k), 10, 5)
    g = random.Random(2)
    for _ in range(2000):
        k = "x" * g.randrange(1, 9) + str(g.randrange(30))
        assert r[k] == len(k) and len(r) <= 10 and len(r.old) <= 10
    assert len(calls) < 2000


def test_units_as_the_library():
    e = encoder()
    g = random.Random(3)
    signs = ["a", "the", " ", "  ", "\n", "\t", "'s", "12", ".", ",", "é", "😀", "\x1c", "\x85", " ", "<|endoftext|>", "A"]
    for _ in range(800):
        t = "".join(g.choice(signs) for _ in range(g.randrange(0, 30)))
        assert e.ids(t) == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_batches_of_texts_as_the_library():
    """Every code point between letters, signs and spaces; parts of many texts at once; texts with and without added tokens."""
    e, g = encoder(), random.Random(11)
    want = lambda ts: [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in ts]
    got = lambda ts: [x.tolist() for x in np.split(*(lambda ids, ends: (ids, ends[:-1]))(*e.encode_batch(ts)))]
    points = [c for c in [*range(0x3100), *range(0xFE00, 0x10000), *range(0x1F300, 0x1F700)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c} 1{c}{c}'s  {c}\n {c}'{c}x" for c in map(chr, points)]
    assert got(texts) == want(texts)
    signs = ["a", "b ", "'", "'s", "'ll", " ", "  ", "\n", "1", "é", ".", "<|endoftext|>", "\x1c", "\x85", "\u3000"]
    for _ in range(30):
        texts = [None if g.random() < 0.1 else "".join(g.choice(signs) for _ in range(g.randrange(12))) for _ in range(40)]
        assert got(texts) == want(texts)


def test_edits_ask_the_encoder_for_what_they_touch_only():
    class Asked(dict):
        n = 0

        def __missing__(self, token):
            Asked.n += 1
            return len(encoder()._token(token))

    tree = CountTree(prose(30, 3000))
    tree.encoder = type("E", (), {"counts": Asked(), "pre_tokens": encoder().pre_tokens, "has_added": encoder().has_added, "added": encoder().added, "longest_added": encoder().longest_added})()
    before, tree.encoded = tree.text, 0
    tree.edit(9000, 9000, " " + prose(31, 200))
    after = before[:9000] + " " + prose(31, 200) + before[9000:]
    assert tree.encoded == Asked.n < 210 and tree.text == after and max(map(len, tree.leaves)) <= 128
    tree.edit(100, 100, "z")
    assert tree.encoded == Asked.n < 215 and tree.n_tokens == len(encoder().ids(after[:100] + "z" + after[100:]))


def test_added_tokens_as_the_library():
    """With the library's own defaults, in whole texts and through edits that make and break them."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = lambda x: t.encode(x, add_special_tokens=False).ids
    ids = lambda x: encoder().ids(x)
    assert ids("a<|endoftext|>b") == [64, 50256, 65]
    g = random.Random(10)
    end = "<|endoftext|>"
    signs = ["a", "b", " ", "  ", "\n", "word", "'s", "1", "!?", "<", "|", "<|", "<|endof", "text|>", "|>", ">", "endoftext", end, end[:-1], end[1:], "é"]
    text = lambda n: "".join(g.choice(signs) for _ in range(n))
    for _ in range(400):
        s = text(g.choice([0, 1, 5, 80, 300]))
        assert ids(s) == want(s), repr(s)
        tree = CountTree(s)
        for _ in range(12):
            a = g.randint(0, len(s) + 2)
            b, x = a + g.choice([0, 0, 1, 5, 60]), text(g.choice([0, 1, 1, 5, 200]))
            tree.edit(a, b, x)
            s = s[:a] + x + s[b:]
            assert tree.text == s and tree.n_tokens == len(want(s)), repr(s)
            assert [p for leaf in tree.leaves for p in leaf] == encoder().pre_tokens(s)


@pytest.mark.parametrize("top", [200, 70_000, 2**31])
def test_token_file_random_access(top):
    g = random.Random(4)
    ids = np.array([g.randrange(g.choice([10, 300, top])) for _ in range(3000)], np.uint32)
    f = token_files.TokenFile(token_files.pack([5, None, 9], np.array([0, 1000, 1000, 3000]), ids))
    assert f.doc_ids == [5, None, 9] and len(f) == 3000
    assert f.ids().tolist() == ids.tolist() == [f[i] for i in range(3000)]
    assert f.document(0).tolist() == ids[:1000].tolist() and f.document(1).tolist() == []
    for _ in range(200):
        a, b = sorted((g.randrange(3001), g.randrange(3001)))
        assert f.between(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        f[3000]
    empty = token_files.TokenFile(token_files.pack([], np.array([0]), np.zeros(0, np.uint32)))
    assert len(empty) == 0 and empty.ids().tolist() == []
    with pytest.raises(ValueError):
        token_files.TokenFile(b"something else")


def by_library(text):
    """The pre-tokens that the library itself finds."""
    return [text[a:b] for _, (a, b) in encoder().tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_count_tree_follows_random_edits():
    g = random.Random(5)
    signs = ["a", "b", " ", "  ", "\n", "word", " the", "'s", "1", "22", ".", "!?", "\t", "é", "😀", "'"]
    text = lambda n: "".join(g.choice(signs) for _ in range(n))
    t = encoder().tokenizer
    for _ in range(300):
        s = text(g.choice([0, 1, 5, 80, 400]))
        tree = CountTree(s)
        for _ in range(g.choice([1, 4, 15])):
            a = g.randint(0, len(s) + 2)
            b, x = a + g.choice([0, 0, 1, 5, 60]), text(g.choice([0, 1, 5, 200]))
            tree.edit(a, b, x)
            s = s[:a] + x + s[b:]
            assert tree.text == s and [p for leaf in tree.leaves for p in leaf] == encoder().pre_tokens(s) == by_library(s)
        assert tree.n_tokens == len(t.encode(s, add_special_tokens=False).ids) and tree.n_chars == len(s)


def test_minhash_estimate_and_sets():
    a = prose(6, 400).split(" ")
    b = list(a)
    for i in range(0, 400, 57):
        b[i] = "other"
    texts = [" ".join(a).encode(), " ".join(b).encode(), b"", b"  ", b"A b", b"a B\n", b"a b c"]
    values, ends = near_dedup.shingle_sets(texts, 4)
    sets = [set(x.tolist()) for x in np.split(values, ends[:-1])]
    assert [len(s) for s in sets] == [397, len(sets[1]), 0, 0, 1, 1, 1]
    assert sets[4] == sets[5] != sets[6]
    s = near_dedup.signatures(values, ends)
    words = [(int(s[f"s{w}"][0]) ^ int(s[f"s{w}"][1])) & (2**64 - 1) for w in range(near_dedup.N_WORDS)]
    unlike = sum(bin((x | x >> 1) & 0x5555555555555555).count("1") for x in words)
    estimate = (1 - unlike / near_dedup.N_HASHES - 0.25) / 0.75
    assert estimate == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]), abs=0.15)
    assert 0.6 < near_dedup.least(80, 256) < 0.7 < near_dedup.least(80, 1024) < 0.8


def test_components(spark):
    g = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(g.randrange(600, 700), g.randrange(600, 700)) for _ in range(60)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_exact_dedup_with_digests_that_lie(spark, corpus):
    """Full bytes decide: with a digest of one bit the groups are the same."""
    docs = spark.read.parquet(corpus + "/documents.parquet")
    weak = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 1)
    cols = ["_f", "_r", "doc_id", "keep_id", "group_size", "kept"]
    good = exact_dedup.exact_dedup(docs).select(cols).collect()
    for digest in (weak, lambda text: F.lit(b"same")):
        assert sorted(map(repr, exact_dedup.exact_dedup(docs, digest).select(cols).collect())) == sorted(map(repr, good))


def test_exact_dedup_state_goes_on(spark, tmp_path):
    """Rows that come later meet the state that earlier ones left; it never expires."""
    rows = lambda ids: spark.createDataFrame([(b"d", i, 1, i) for i in ids], "digest binary, doc_id long, _f long, _r long")
    for ids in ((5, 7), (3, 9), (4,)):
        rows(ids).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows((1,)).schema).parquet(str(tmp_path / "in"))
        exact_dedup.first_seen(stream, str(tmp_path / f"out{ids[0]}"), str(tmp_path / "checkpoint"))
        (state,) = exact_dedup.states(spark, str(tmp_path / f"out{ids[0]}")).collect()
    assert (state.first.doc_id, state.n) == (3, 5)


def test_kept_and_repeated_rows(spark, corpus):
    docs = spark.read.parquet(corpus + "/documents.parquet")
    kept = exact_dedup.kept_rows(docs, exact_dedup.exact_dedup(docs))
    assert kept.columns == docs.columns and kept.count() == len({tuple((r.text or "").split()) + ("",) * (not r.text) for r in docs.collect()})
    mixed = mixing.mix(docs)
    again = mixing.repeated(docs, mixed)
    assert again.columns == docs.columns and again.count() == mixed.agg(F.sum("copies")).collect()[0][0]


def test_a_frame_that_is_no_file_scan(spark, corpus):
    docs = spark.read.parquet(corpus + "/documents.parquet")
    assert mixing.mix(docs.distinct()).count() == docs.distinct().count()


def test_language_accuracy(spark, write):
    """Held-out accuracy on four made-up languages; short texts too."""
    g = random.Random(8)
    sounds = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "en", "ung", "ber"], "cc": ["eau", "ou", "ment", "é"], "dd": ["ción", "ado", "os", "ñ"]}
    rows = []
    for i in range(600):
        lang = g.choice(sorted(sounds))
        text = " ".join("".join(g.choice(sounds[lang]) for _ in range(g.randint(1, 3))) for _ in range(g.choice([3, 10, 60])))
        rows.append((i, text, lang, "s", 0, "k", "f", 1, "z", 0))
    folder = write(rows)
    truth = {r[0]: r[2] for r in rows}
    got = [r for r in language.query(spark, folder).collect() if r.held_out]
    assert len(got) > 100 and sum(truth[r.doc_id] == r.lang_pred for r in got) / len(got) > 0.97


def test_elastic_net_is_sparse_and_temperature_calibrates():
    g = np.random.default_rng(1)
    rows = [(np.array([y, 10 + k % 50]), np.array([0.8, 0.6])) for k, y in enumerate(g.integers(0, 2, 400).tolist())]
    labels = np.array([r[0][0] for r in rows])
    w, _ = language.ftrl(rows, labels, 2)
    assert (w[:2] != 0).all() and (w[100:] == 0).all()
    loose, _ = language.ftrl(rows, labels, 2, l1=0.0)
    assert (w == 0).sum() > (loose == 0).sum()
    z = g.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([g.choice(3, p=q) for q in p])
    assert language.temperature(3 * z, y) == pytest.approx(3, rel=0.15)


def test_suffix_arrays():
    g = np.random.default_rng(2)
    for _ in range(400):
        n, k = int(g.integers(1, 60)), int(g.choice([1, 2, 3, 200]))
        s = np.append(g.integers(1, k + 1, n), 0).astype(np.uint16)
        sa, text = suffix_array(s), s.tolist()
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        share = common_prefixes(s, sa, np.full(len(text), len(text)))
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            k = 0
            while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert share[b] == k


def test_targets_by_water_filling(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 7), ("d", 0), ("e", 3000), (None, 40)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert sum(got.values()) == pytest.approx(1.5 * sum(n for _, n in sizes))
    assert all(got[s] <= 2 * n + 1e-9 for s, n in sizes)
