"""The parts of the operators against plain versions."""

from __future__ import annotations

import math
import random
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidewell.llm import ann, language_id, minhash_forest, piece_sampling as ps, progressive_jpeg as pj
from tidewell.llm.shingles import shingle_sets


def test_chi_square():
    assert abs(ann.chi2_cdf(9.487729, 4) - 0.95) < 1e-6  # tabulated
    assert abs(ann.chi2_quantile(0.95, 10) - 18.307038) < 1e-5


def test_tree_distances_bound_all_points():
    x = np.random.default_rng(1).normal(size=(500, 4))
    tree = ann.Tree(x, 20)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(500))
    leaf = tree.leaf_of(x)
    gaps = tree.distances(x[:30])
    for q in range(30):
        true = ((x - x[q]) ** 2).sum(1)
        for k, rows in enumerate(tree.leaves):
            assert gaps[q, k] <= true[rows].min() + 1e-9
            assert (leaf[rows] == k).all()


def test_points_come_by_projected_distance_until_the_test_holds():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 48))[rng.integers(0, 50, 2000)] + 0.25 * rng.normal(size=(2000, 48))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    low = u @ ann.projection(48, 10)
    stop = ann.chi2_quantile(0.97, 10)
    hit = seen = 0
    for i, at, verified in ann.search_cell(u, low, u[:60], low[:60], np.full(60, 4.0), 6, stop):
        want = np.argsort(-(u @ u[i]), kind="stable")[:6]
        hit += len(set(want.tolist()) & set(at.tolist()))
        seen += verified
    assert hit / 360 >= 0.95 and seen / (60 * 2000) < 0.5
    whole = {i: (set(at.tolist()), n) for i, at, n in ann.search_cell(u, low, u[:9], low[:9], np.full(9, 4.0), 6, np.inf)}
    assert all(n == 2000 and set(np.argsort(-(u @ u[i]), kind="stable")[:6].tolist()) <= at for i, (at, n) in whole.items())


@pytest.mark.parametrize("most_cells", [4096, 2])
def test_recall_on_clusters(spark, monkeypatch, most_cells):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ann, "MOST_CELLS", most_cells)  # beyond them, cells are dealt out in parts
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 32))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, 5, cell_rows=200, query_block=16).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        hit += len(set(np.lexsort((np.arange(3000), -s))[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 300 and hit / 300 >= 0.9


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> i) & 1 for i in range(width - 1, -1, -1)]

    def done(self):
        return np.packbits(np.array(self.bits + [1] * (-len(self.bits) % 8), np.uint8)).tobytes()


def plain_jpeg(coefs, restart):
    """A one-component progressive JPEG with runs, end-of-band runs and two refinements, written symbol by symbol; every code has 8 bits."""
    n = len(coefs)
    code = {s: i for i, s in enumerate(sorted({*range(12), *(r << 4 | s for r in range(16) for s in (0, 1, 2, 3, 4, 5, 6, 7, 8))}))}
    table = {8: sorted(code)}
    size = lambda v: abs(v).bit_length()
    extra = lambda v: v if v > 0 else v + (1 << size(v)) - 1
    runs = [range(k, min(n, k + restart)) for k in range(0, n, restart)] if restart else [range(n)]

    def scan(ss, se, ah, al, write):
        parts = []
        for blocks in runs:
            w = Writer()
            write(w, blocks)
            parts.append(w.done().replace(b"\xff", b"\xff\x00"))
        body = parts[0] + b"".join(bytes([0xFF, 0xD0 + k % 8]) + p for k, p in enumerate(parts[1:]))
        return pj._segment(0xDA, bytes([1, 1, 0, ss, se, ah << 4 | al])) + body

    def dc_first(w, blocks):
        last = 0
        for b in blocks:
            v = coefs[b][0] >> 1
            d, last = v - last, v
            w.put(code[size(d)], 8)
            if d:
                w.put(extra(d), size(d))

    def dc_more(w, blocks):
        for b in blocks:
            w.put(coefs[b][0] & 1, 1)

    def shifted(v, al):
        return (abs(v) >> al) * (1 if v > 0 else -1)

    def end_run(w, run):
        if run:
            k = run.bit_length() - 1
            w.put(code[k << 4], 8)
            if k:
                w.put(run - (1 << k), k)

    def ac_first(ss, se, al):
        def write(w, blocks):
            eob = 0
            for b in blocks:
                zeros = 0
                for k in range(ss, se + 1):
                    v = shifted(coefs[b][k], al)
                    if not v:
                        zeros += 1
                        continue
                    end_run(w, eob)
                    eob = 0
                    while zeros > 15:
                        w.put(code[0xF0], 8)
                        zeros -= 16
                    w.put(code[zeros << 4 | size(v)], 8)
                    w.put(extra(v), size(v))
                    zeros = 0
                if zeros:
                    eob += 1
            end_run(w, eob)
        return write

    def ac_more(ss, se, al):
        def write(w, blocks):
            for b in blocks:
                zeros, held = 0, []
                new = [k for k in range(ss, se + 1) if abs(coefs[b][k]) >> al == 1]
                for k in range(ss, se + 1):
                    m = abs(coefs[b][k]) >> al
                    if m > 1:
                        held.append(m & 1)
                        continue
                    if m == 0:
                        zeros += 1
                        if zeros == 16 and new and new[-1] > k:
                            w.put(code[0xF0], 8)
                            for x in held:
                                w.put(x, 1)
                            zeros, held = 0, []
                        continue
                    w.put(code[zeros << 4 | 1], 8)
                    w.put(int(coefs[b][k] > 0), 1)
                    for x in held:
                        w.put(x, 1)
                    zeros, held = 0, []
                if zeros or held:
                    w.put(code[0], 8)
                    for x in held:
                        w.put(x, 1)
        return write

    head = b"\xff\xd8" + pj._QUANT + pj._segment(0xC2, struct.pack(">BHHB", 8, 8, 8 * n, 1) + bytes([1, 0x11, 0])) + pj._table(0, 0, table) + pj._table(1, 0, table)
    head += pj._segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + scan(0, 0, 0, 1, dc_first) + scan(1, 9, 0, 2, ac_first(1, 9, 2)) + scan(10, 63, 0, 2, ac_first(10, 63, 2)) + scan(1, 63, 2, 1, ac_more(1, 63, 1)) + scan(0, 0, 1, 0, dc_more) \
        + scan(1, 63, 1, 0, ac_more(1, 63, 0)) + b"\xff\xd9"


def test_any_progressive_jpeg():
    rng = random.Random(5)
    for restart in (0, 1, 4):
        coefs = [[rng.choice([0] * rng.choice([1, 3, 12, 60]) + [rng.randint(-200, 200)]) for _ in range(64)] for _ in range(23)]
        coefs[4] = coefs[5] = coefs[6] = [9] + [0] * 63
        assert pj.read_coefficients(plain_jpeg(coefs, restart)).components[0].coefs.tolist() == coefs


def test_fixed_width_scans_equal_the_general_path(monkeypatch):
    data = random.Random(2).randbytes(64 * 37)
    media = pj.encode_payload(data)
    fast = [c.coefs.copy() for c in pj.read_coefficients(media).components]
    pj._tables_seen.clear()
    plain = pj._huffman

    def without_shortcut(counts, symbols):
        table = plain(counts, symbols)
        table.only = None
        return table

    monkeypatch.setattr(pj, "_huffman", without_shortcut)
    slow = [c.coefs for c in pj.read_coefficients(media).components]
    pj._tables_seen.clear()
    assert all((a == b).all() for a, b in zip(fast, slow, strict=True))


def test_inverse_transform_and_colour():
    assert pj.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    block = np.zeros(64, np.float32)
    block[0] = 80
    assert np.allclose(block @ pj.INVERSE, 10)
    image = pj.read_coefficients(plain_jpeg([[80] + [0] * 63], 0))
    assert (pj.to_rgb(image) == 138).all()


def test_viterbi_is_best():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 60, 6)
        doc, scores = np.repeat(np.arange(6), lengths), rng.normal(0, 2, (lengths.sum(), 3)).astype(np.float32)
        got, at = language_id.viterbi(scores, doc, 3.0, 7), 0
        for n in lengths:
            s, lab = scores[at:at + n], got[at:at + n]
            v = s[0].astype(float)
            for t in range(1, n):
                v = np.maximum(v, v.max() - 3.0) + s[t]
            assert abs(s[np.arange(n), lab].sum() - 3.0 * (np.diff(lab) != 0).sum() - v.max()) < 1e-2
            at += n


def test_scripts_narrow():
    words = language_id.split_words(["Привет world 12", ""])
    assert [language_id.SCRIPTS[s - 1][0] for s in words.script] == ["cyrillic", "latin"] and words.doc.tolist() == [0, 0]


def test_shingles_are_sets_of_five_words():
    texts = ["a b c d e f", "A, b! c d  e f", "one two", "", "a b c d e a b c d e a b c d e"]
    got = shingle_sets(texts)
    assert [len(s) for s in got] == [2, 2, 1, 0, 5] and (got[0] == got[1]).all()


def test_forest_keeps_recall():
    assert minhash_forest.prefix_length(0.8, 16, 8, 0.995) == 5
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    pairs = [(base[:360], np.concatenate([base[40:360], rng.integers(0, 1 << 63, 40, dtype=np.uint64)])) for _ in range(3)]
    for a, b in pairs:
        sig = minhash_forest.signatures([np.unique(a), np.unique(b)])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - j) < 0.15


def test_exact_links():
    sets = [np.arange(0, 100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64), np.arange(12, 112, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    links, star = minhash_forest.class_links(sets, np.array([1, 10, 100, 1000]), 0.8)
    assert links.tolist() == [10, 101, 10, 0] and star == [(0, 0), (1, 0), (2, 0), (3, 3)]


def test_prefixes_are_shortened_by_measured_recall():
    assert minhash_forest.shortened(5, {}) == 5 and minhash_forest.shortened(5, {8: 900, 5: 100}) == 5
    assert minhash_forest.shortened(5, {8: 970, 4: 30}) == 4 and minhash_forest.shortened(5, {8: 900, 4: 50, 2: 50}) == 2 and minhash_forest.shortened(5, {0: 9}) == 1
    sig = np.arange(128, dtype=np.uint32)
    other = np.stack([sig, np.where(np.arange(128) % 8 == 5, 999, sig), np.where(np.arange(128) == 127, 999, sig), sig + 1000])
    assert minhash_forest.meeting_depths(sig, other).tolist() == [8, 5, 8, 0]


def parts_of(n, links):
    root = list(range(n))
    for a, b in links:
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if x in (ra, rb) else x for x in root]
    return root


def test_near_copies_leave_a_node_by_their_leader():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 256, (2, 128), dtype=np.uint8)
    bits = np.array([np.where(rng.random(128) < 0.05, rng.integers(0, 256, 128, dtype=np.uint8), centre[i % 2]) for i in range(60)])
    links: list = []
    radius = np.zeros(60)
    leaders = minhash_forest.lead(np.arange(60), bits, radius, 0.8, links, np.arange(60))
    assert parts_of(60, links) == [i % 2 for i in range(60)] and len(leaders) < 30
    assert radius.max() <= 1 - minhash_forest.NEAR + 1e-9 and (radius > 0).any()
    assert len(links) == 58
    few = minhash_forest.spanning(60, links)
    assert len(few) == 58 and parts_of(60, few) == [i % 2 for i in range(60)]


def test_a_node_of_texts_that_are_somewhat_alike_gives_fewer_links_than_texts():
    """6,000 texts about 0.85 alike, none near enough to follow another: all pairs are candidates, and a spanning part of them is kept."""
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 256, 128, dtype=np.uint8)
    bits = np.where(rng.random((6000, 128)) < 0.08, rng.integers(0, 256, (6000, 128), dtype=np.uint8), centre)
    assert 0.8 < minhash_forest.estimate(bits[0], bits[1:]).mean() < 0.9
    links: list = []
    root = np.arange(6000)
    minhash_forest.lead(np.arange(6000), bits, np.zeros(6000), 0.8, links, root)
    assert len(links) == 5999 and len(set(minhash_forest.found_root(root, np.arange(6000)).tolist())) == 1


def test_tries_climb_from_full_depth():
    """Nodes of any prefix are joined as brute force over the last prefix joins them, wherever ranges of sorted paths end."""
    rng = np.random.default_rng(4)
    n = 120
    family = rng.integers(0, 12, n)
    centre = rng.integers(0, 256, (12, 128), dtype=np.uint8)
    bits = np.where(rng.random((n, 128)) < 0.04, rng.integers(0, 256, (n, 128)), centre[family]).astype(np.uint8)
    paths = np.where(rng.random((n, 8)) < 0.05, rng.integers(0, 50, (n, 8)), family[:, None] // 4).astype(np.uint32)
    order = np.lexsort(paths.T[::-1])
    paths, bits, family = paths[order], bits[order], family[order]
    length = 3
    links, leaders, radius = minhash_forest.climb(paths, bits, length)
    assert all((paths[a, :length] == paths[b, :length]).all() and minhash_forest.estimate(bits[a], bits[b:b + 1])[0] > 0.4 for a, b in links)
    want = parts_of(n, [(i, j) for i in range(n) for j in range(i) if (paths[i, :length] == paths[j, :length]).all() and family[i] == family[j]])
    assert parts_of(n, links) == want and len(leaders) < n


def test_a_node_over_many_ranges_stays_together(spark):
    """One class of near copies that is most of the table, in more sorted ranges than it has tries."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:200] + [f"x{i}"] + words[201:])) for i in range(150)] + [(1000 + i, " ".join(f"y{i}z{j}" for j in range(60))) for i in range(40)] + [(2000, None), (2001, "y3z1 y3z2")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    try:
        got = {r.doc_id: (r.class_id, r.n_links) for r in minhash_forest.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: (0, 149) if i < 150 else (i, 0) for i, _ in rows}


def test_components(spark):
    from tidewell.llm.graph import components

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(300, i) for i in range(301, 330)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def every_segmentation(text, v):
    s = ps.BLANK + text.replace(" ", ps.BLANK)
    ids = {v.model.id_to_piece(i): i for i in range(v.model.vocab_size()) if not (v.model.is_byte(i) or v.model.is_control(i) or v.model.is_unknown(i))}
    found = []

    def go(i, path, log):
        if i == len(s):
            found.append((tuple(path), log))
        elif s[i] not in ids:
            raw = s[i].encode()
            go(i + 1, [*path, *(v.byte_ids[x] for x in raw)], log + len(raw) * v.byte_log)
        for j in range(i + 1, min(len(s), i + 16) + 1):
            if s[i:j] in ids:
                go(j, [*path, ids[s[i:j]]], log + v.logs[ids[s[i:j]]])
    go(0, [], 0.0)
    z = np.logaddexp.reduce([x for _, x in found])
    return {k: x - z for k, x in found}


def test_samples_without_replacement():
    v = ps.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 0.3)
    text, n = "a cat é", 6000
    all_of = every_segmentation(text, v)
    got = ps.top_k([text] * n, list(range(n)), ps.Store(v), 3)
    key = lambda r: tuple(np.frombuffer(r[0], "<u4").tolist())
    firsts = Counter(key(rows[0]) for rows in got)
    for k, log in all_of.items():
        p = math.exp(log)
        assert abs(firsts[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    second = Counter()
    for a, la in all_of.items():
        for b, lb in all_of.items():
            if a != b:
                second[b] += math.exp(la + lb) / (1 - math.exp(la))
    seconds = Counter(key(rows[1]) for rows in got)
    for k, p in second.items():
        assert abs(seconds[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    assert all(len({key(r) for r in rows}) == 3 and rows[0][3] >= rows[1][3] >= rows[2][3] for rows in got)
    assert all(abs(all_of[key(r)] - r[2]) < 1e-5 for rows in got[:300] for r in rows)
    # inverse inclusion weights are unbiased
    assert abs(np.mean([sum(math.exp(r[2] - r[4]) for r in rows) for rows in got]) - 1) < 0.02
    few = ps.top_k(["a"], [1], ps.Store(v), 9)[0]
    assert len(few) == len(every_segmentation("a", v)) and few[-1][4] == 0.0


def test_decoding_is_the_library():
    v = ps.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["Hello world", "  two  blanks ", "tab\tnewline\n\n", "東京 é 👋", "", "x"]
    ids = [v.model.encode(t) for t in texts]
    assert ps.decode_ids([np.array(i, "<u4").tobytes() for i in ids], v) == [v.model.decode(i) for i in ids] == texts


def test_a_full_store_gives_the_same_samples(monkeypatch):
    """Whatever units a worker has met before or dropped, and whether hashes collide: draws don't change."""
    v = ps.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [f"word{i} other{i % 7}  again, it's\n{'x' * (i % 5)} 東京{i}" for i in range(60)] + ["", " ", "a▁b"]
    fresh, worn = ps.Store(v), ps.Store(v)
    want = [ps.top_k([t], [i], fresh, 2)[0] for i, t in enumerate(texts)]
    renew = worn.renew
    monkeypatch.setattr(worn, "renew", lambda: renew(20))
    got = [ps.top_k([t], [i], worn, 2)[0] for i, t in enumerate(texts)]
    assert got == want and worn.sizes["start"] < 60
    assert ps.top_k(texts, list(range(len(texts))), worn, 2) == want
    monkeypatch.setattr(ps, "mix", lambda x, real=ps.mix: real(x) % np.uint64(1 << 14))  # hashes of few bits collide
    assert [len(rows) for rows in ps.top_k(texts, list(range(len(texts))), ps.Store(v), 2)] == [len(rows) for rows in want]


def test_units():
    v = ps.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    import regex

    texts = ["a cat's  nap", "", "  x ", "12ab,é \n\n東京x", "▁▁ y▁z "]
    codes, starts, before = ps.split_units(texts, v.letters_apart)
    got = ["".join(map(chr, codes[a:b])) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    pattern = rf"{ps.BLANK}*\p{{L}}+|{ps.BLANK}*[^\p{{L}}{ps.BLANK}]+|{ps.BLANK}+" if v.letters_apart else f"{ps.BLANK}+[^{ps.BLANK}]*|[^{ps.BLANK}]+"
    want = [regex.findall(pattern, ps.BLANK + t.replace(" ", ps.BLANK) if t else "") for t in texts]
    assert [got[a:b] for a, b in zip(before[:-1], before[1:], strict=True)] == want


def test_every_word_token_merges_to_itself():
    """Then merging by ranks equals merging by the vocabulary's list of pairs, in any context."""
    import json

    from tidewell.llm import packing

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        model = json.load(f)["model"]
    pairs = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    merge, id_of = packing.merger(public_tokenizers.path("word_bpe_49k.json"))
    of = packing.alphabet()
    for token, number in model["vocab"].items():
        bare = token.removesuffix("</w>")
        parts = [*bare[:-1], bare[-1] + token[len(bare):]]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: pairs.get((parts[i], parts[i + 1]), 1 << 30))
            assert (parts[best], parts[best + 1]) in pairs, token
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [token]
        assert id_of[merge(packing.token_bytes(token, of))].tolist() == [number]
