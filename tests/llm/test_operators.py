"""Each operator against brute force on a small table with nulls, empty and long texts,
copies, ties and extra columns; and on an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor long, c long, k string"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    base = text(300)
    out = [None, "", " \n\t ", "one", "Two words", base, base, base.upper(), passage, text(60) + " " + passage + "\n" + text(40), passage + " " + text(70), "a " * 400, "x" * 700, text(4000)]
    near = base.split(" ")
    near[150] = "changed"
    out += [" ".join(near), " ".join(near[:290]), text(30) + " " + passage[:250]]
    return [(i * 7 % 17, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 0, i, i, "x") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return {r[0]: r[1] or "" for r in corpus()}


def test_substring_dedup(docs, none):
    from rulespan.llm.substring import dedup_substrings

    seen, want = {}, {}
    for d, t in sorted(texts().items()):
        w, gone = WORD.findall(t), set()
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), d) < d:
                gone.update(range(i, i + 50))
        want[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(docs).collect()} == want
    assert dedup_substrings(none).count() == 0


def test_suffix_dedup(docs, none):
    from rulespan.llm.suffix_dedup import dedup_suffixes

    seen, want = set(), {}
    for d, t in sorted(texts().items()):
        b = t.encode()
        mark = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                mark[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        want[d] = (len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(bytes(c for c, m in zip(b, mark) if not m)).hexdigest())
    # A small shard makes the sort use its disk-backed queues.
    got = dedup_suffixes(docs, shard=2000).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert dedup_suffixes(none).count() == 0


def test_suffix_sort(tmp_path):
    from rulespan.llm.suffix import External, sort_suffixes

    rng = np.random.default_rng(1)
    for turn in range(120):
        n, a = int(rng.integers(1, 60)), int(rng.integers(1, 5))
        body = np.tile(rng.integers(1, a + 1, max(1, n // 6)), 6) if turn % 3 == 0 else rng.integers(1, a + 1, n)
        t = np.append(body, 0).tolist()
        order = sorted(range(len(t)), key=lambda i: t[i:])
        common = [0]
        for i, j in zip(order[1:], order):
            k = 0
            while t[i + k] == t[j + k]:
                k += 1
            common.append(k)
        o, c = sort_suffixes(np.array(t), External(str(tmp_path), int(rng.choice([5, 17, 10**6]))))
        assert (o.tolist(), c.tolist()) == (order, common)


def test_jaccard(docs, none):
    from rulespan.llm.jaccard import Bands, join_components

    fold = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for d, t in texts().items():
        w = WORD.findall(t.translate(fold))
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    comp = {d: d for d in sets}
    while True:
        old = dict(comp)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == old:
            break
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in join_components(docs).collect()} == {d: (len(sets[d]), comp[d]) for d in sets}
    assert join_components(none).count() == 0
    # Linking sets share a key whatever the allocation, and so do their neighbours by one shingle.
    rng = np.random.default_rng(3)
    for crowd in (0, 10**12):
        bands = Bands(90, dict.fromkeys(range(60), crowd))
        for n in (3, 9, 10, 12, 40, 200):
            a = rng.integers(1, 2**63, n).astype(np.uint64)
            for cut in range(1 + n // 20):
                b = np.append(a[: n - cut], rng.integers(1, 2**63, cut).astype(np.uint64))
                if 100 * (n - cut) >= 90 * (n + cut):
                    assert np.intersect1d(bands.keys(a), bands.keys(b)).size


def test_embeddings(spark):
    from rulespan.llm.embedding import near_vectors

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([rng.normal(size=(150, 32)), centres + 0, centres + 0.25 * rng.normal(size=(40, 32)), centres[:10] * 3, centres[:5] + 0.1 * rng.normal(size=(5, 32))]).astype(np.float32)
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, [None] * 32, 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    total = int(link.sum())
    assert total > 40 and sum(got[i][0] for i in range(len(x))) >= 0.9 * total
    assert all(got[i][0] <= link[i].sum() for i in range(len(x)))
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903))


def test_embedding_recall_at_the_widths_of_large_tables():
    import pyarrow as pa

    from rulespan.llm import embedding

    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    sample = unit(rng.normal(size=(3000, 64)) * np.linspace(1.5, 0.5, 64))
    one = unit(rng.normal(size=(2000, 64)) * np.linspace(1.5, 0.5, 64))
    away = rng.normal(size=one.shape)
    two = 0.9 * one + np.sqrt(1 - 0.81) * unit(away - (away * one).sum(axis=1, keepdims=True) * one)

    def recall(models, width):
        def keys(x):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array([v.tobytes() for v in x], pa.binary())], names=["c", "unit"])
            out = next(embedding._codes(models, width)(iter([batch])))
            return set(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))

        return len({c for _, c in keys(one) & keys(two)}) / len(one)

    for width in (8, 17, 22, 24, 27):
        models = embedding.learn_enough(sample, 64, width, 21, 0.9, 11)
        assert recall(models, width) >= 0.92, width
        if width <= 17:
            assert len(models) == 2
        elif width >= 24:
            # As many codes as small tables have are too few.
            assert recall(models[:2], width) < 0.9


def test_packing(docs, none):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from rulespan.llm.packing import pack

    path = public.path("byte_bpe_50k.json")
    pieces = pack(docs, path).collect()
    tok = Tokenizer.from_file(path)
    ids = {d: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], np.uint32) for d, t in texts().items()}
    by = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == by.get(p.doc_id, 0) and p.doc_tokens == len(ids[p.doc_id])
        by[p.doc_id] = p.start + p.length
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert by == {d: len(x) for d, x in ids.items()}
    seq = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == seq.get(p.sequence_id, 0)
        seq[p.sequence_id] = p.offset + p.length
    assert max(seq.values()) <= 1024
    assert pack(none, path).count() == 0


def test_language_model(docs, none):
    import math

    from rulespan.llm.ngram import train_and_score

    fold = {i: i + 32 for i in range(65, 91)}
    words = {d: [*WORD.findall(t.translate(fold)), None] for d, t in texts().items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in words}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for order in (2, 3):
        for r in train_and_score(docs, order).collect():
            ws = words[r.doc_id]
            base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
            assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    assert train_and_score(none).count() == 0


def test_language_model_keeps_every_gram_up_to_order_3(docs, monkeypatch):
    import math

    from rulespan.llm import ngram

    fold = {i: i + 32 for i in range(65, 91)}
    words = {d: ["</s>", *WORD.findall(t.translate(fold)), "</s>"] for d, t in texts().items()}
    train = [ws for d, ws in words.items() if zlib.crc32(str(d).encode()) % 10]
    one = Counter(w for ws in train for w in ws[1:])
    two = Counter(g for ws in train for g in zip(ws, ws[1:]))
    three = Counter(g for ws in train for g in zip(ws, ws[1:], ws[2:]))
    n, v = sum(one.values()), len(one)
    after = {1: Counter(g[:1] for g in two), 2: Counter(g[:2] for g in three)}

    def p(gram):
        if len(gram) == 1:
            return (one[gram[0]] + 0.1) / (n + 0.1 * (v + 1))
        context = gram[:-1]
        total = one[context[0]] if len(context) == 1 else two[context]
        if not after[len(context)][context]:
            return p(gram[1:])
        c = (two if len(gram) == 2 else three)[gram]
        return max(c - 0.75, 0) / total + 0.75 * after[len(context)][context] / total * p(gram[1:])

    got = {r.doc_id: r.score for r in ngram.train_and_score(docs).collect()}
    # Small shards and ranges cut contexts in the middle, and queues go to disk.
    for name, value in (("SHARD", 7), ("DEALT", 50), ("SORTED", 40), ("MAPPED", 3), ("TOKENS", 100)):
        monkeypatch.setattr(ngram, name, value)
    shards = {r.doc_id: r.score for r in ngram.train_and_score(docs).collect()}
    assert shards == pytest.approx(got)
    for d, ws in words.items():
        want = sum(math.log10(p(tuple(ws[max(0, i - 2) : i + 1]))) for i in range(1, len(ws)))
        # Values are rounded down by at most 9 / 65535; two are added for each of two orders.
        assert -2.8e-4 * (len(ws) - 1) <= got[d] - want <= 1e-9, d


def test_packed_grams_round_trip():
    from rulespan.llm.ngram import distinct_grams, pack_grams, unpack_grams

    rng = np.random.default_rng(6)
    for high in (50, 2**40, 2**61):
        a, w = rng.integers(high - 40, high, 500), rng.integers(0, 1000, 500)
        got = distinct_grams(a, w, 1000)
        want = Counter(zip(a.tolist(), w.tolist()))
        assert [(x, y, want[x, y]) for x, y in sorted(want)] == list(zip(*(g.tolist() for g in got)))
        assert all((x == y).all() for x, y in zip(unpack_grams(pack_grams(*got)), got))


def test_elias_fano():
    from rulespan.llm.elias_fano import EliasFano

    rng = np.random.default_rng(4)
    for n, top in ((1, 1), (5, 3), (100, 10**12), (1000, 5000), (3000, 2**40)):
        v = np.sort(rng.integers(0, top, n))
        ef = EliasFano.build(v, top)
        assert (ef.access(np.arange(n)) == v.astype(np.uint64)).all()
        two = ef.access_two(np.arange(n - 1))
        assert (two[0] == v[:-1].astype(np.uint64)).all() and (two[1] == v[1:].astype(np.uint64)).all()
        x = np.concatenate([v, rng.integers(0, top, 50)])
        assert (ef.successor(x) == np.searchsorted(v, x)).all()
        assert ((ef.find(x) >= 0) == np.isin(x, v)).all()


def test_mixing(docs, none):
    from rulespan.llm.mixing import mix

    rows = mix(docs).collect()
    size = {d: len(WORD.findall(t)) for d, t in texts().items()}
    assert {r.doc_id: r.size for r in rows} == size
    source = {r[0]: r[3] for r in corpus()}
    total = Counter()
    for d, s in source.items():
        total[s] += size[d]
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= over
    taken = Counter()
    for r in rows:
        assert r.source_size == total[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert mix(none).count() == 0


def test_media(docs, none):
    from rulespan.llm.media import decode_png, encode_png, media_table, payload_of

    got = {r.doc_id: r for r in media_table(docs).collect()}
    for d, t in texts().items():
        p = payload_of(t.encode())
        assert decode_png(encode_png(p)) == p and len(p) % 64 == 0 and p
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(encode_png(p)).hexdigest()
    assert len(got) == len(texts())
    assert media_table(none).count() == 0


def test_html(spark):
    from rulespan.llm.html import extract

    page = lambda body: f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>x</a></li></ul></nav><div class=\"ad\">Buy</div>{body}<footer>&copy; f</footer></body></html>"
    rows = [(1, "http://h.org/1", page("<article><h1>A &amp; B</h1><p><b>x  y<br><p>z</p><section class='comments'>no</section></article>"), 0), (2, "http://h.org/2", page("<div class='text'><p>first para of text</p><p>second para</p></div>"), 0), (3, None, None, 0), (4, "x", "", 0), (5, "http://h.org/1", page("<article><h1>A &amp; B</h1><p><b>x  y<br><p>z</p></article>"), 0)]
    got = {r.page_id: (r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    assert got[1] == got[5] == ("A & B\n\nx y\n\nz", 13)
    assert got[2][0] == "first para of text\n\nsecond para"
    assert got[3] == got[4] == ("", 0)


def test_html_template_decides_in_articles(spark):
    from rulespan.llm.html import extract

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda: " ".join(word() for _ in range(20))
    rows, want = [], {}
    for i in range(12):
        # Boilerplate inside the article, under names that no list of boxes has, at no fixed paragraph.
        parts = [text() for _ in range(2 + i % 3)]
        body = [f"<p>{x[:30]}<i>and</i>{x[30:]}</p>" for x in parts]
        body.insert(1 + i % 2, "<div class='zq7'>Terms of <b>this</b> site changed in May</div>")
        rows.append((i, f"http://h.org/{i}", f"<html><body><article><h1>Head {i}</h1>{''.join(body)}<article class='comment'>c{i}</article></article></body></html>"))
        want[i] = "\n\n".join([f"Head {i}", *(f"{x[:30]}and{x[30:]}" for x in parts)])
    # Near copies share their content, which isn't the template's.
    base = [text() for _ in range(6)]
    for i in range(20, 26):
        parts = list(base)
        parts[i % 6] = parts[i % 6].replace(parts[i % 6].split()[3], word(), 1)
        rows.append((i, f"http://n.org/{i}", f"<html><body><article>{''.join(f'<p>{x}</p>' for x in parts)}</article></body></html>"))
        want[i] = "\n\n".join(parts)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_keeps_all_containers(spark):
    from rulespan.llm.html import extract

    bodies = {
        1: ("<section id=intro><p>one is short</p></section><section id=results><p>two is a longer section</p></section>", "one is short\n\ntwo is a longer section"),
        2: ("<h1>Title</h1><div class=content><p>the text</p></div>", "Title\n\nthe text"),
        3: ("<div class=body><p>before</p><blockquote>a quote longer than the prose around it</blockquote><p>after</p></div>", "before\n\na quote longer than the prose around it\n\nafter"),
        4: ("<table><tr><td>left</td><td>right cell</td></tr></table>", "left\n\nright cell"),
    }
    rows = [(i, f"http://one.org/{i}", f"<html><body><nav>menu</nav>{body}<div class=zq7>All of the site's terms</div></body></html>") for i, (body, _) in bodies.items()]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: text for i, (_, text) in bodies.items()}


def test_quality(spark, docs, none):
    from rulespan.llm.quality import classify

    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(60))
    rows, labels = [], []
    for i in range(480):
        # Faulty rows lie in both halves, of which one is labelled.
        bad = i % 8 in (0, 1)
        rows.append((i, good() + (" vileword" if bad else ""), "en", f"h{i % 3}", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in classify(d, lab).collect()}
    assert all(got[i] == (i % 8 not in (0, 1)) for i in got)
    # Labels with nulls, clashing columns and unknown documents.
    odd = spark.createDataFrame([(0, None, None, "x"), (None, 0, 1, "y"), (10**9, 0, 1, "z")], "doc_id long, quality int, toxic int, text string")
    assert classify(d, odd).where("keep").count() == 480
    assert classify(docs, lab).count() == len(texts())
    assert classify(none, lab.limit(0)).count() == 0


def test_a_sparse_site_is_drawn_to_the_rate_of_all(spark):
    from rulespan.llm.quality import site_rates

    # A host of one bad path among many good ones, a host with one row, and a null host.
    rows = [("big", f"p{i % 20}", -6.0) for i in range(2000)] + [("big", "bad", 6.0)] * 200 + [("tiny", "only", 6.0)] + [(None, None, -6.0)] * 50
    rates, rate = site_rates(spark.createDataFrame(rows, "host string, path string, junk_evidence double"), "junk")
    got = {(r.host, r.path): r.junk_site_rate for r in rates.collect()}
    assert len(got) == 23 and 0.05 < rate < 0.15
    assert got["big", "bad"] > 0.5 > got["tiny", "only"] > rate and got["big", "p0"] < rate


def test_long_parities_never_exceed_the_difference():
    from rulespan.llm.jaccard import long_parities, odd_cells

    rng = np.random.default_rng(1)
    for n in (1, 3, 127, 128, 129, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            kept = a[: int(rng.integers(0, n + 1))]
            b = np.unique(np.concatenate([kept, rng.integers(0, 2**64, int(rng.integers(1, n + 2)), dtype=np.uint64)]))
            odd = odd_cells(long_parities(a), long_parities(b))
            assert odd == odd_cells(long_parities(b), long_parities(a))
            assert odd <= len(np.setxor1d(a, b))
        assert odd_cells(long_parities(a), long_parities(a)) == 0


def test_packed_keys_round_trip():
    import pyarrow as pa

    from rulespan.llm.jaccard import _shared, pack_keys, unpack_keys

    rng = np.random.default_rng(8)
    classes = np.sort(rng.choice(10**12, 300, replace=False)).astype(np.int64)
    k = np.sort(rng.integers(0, 2**40, 5000).astype(np.uint64))
    owner = rng.integers(0, 300, 5000).astype(np.uint16)
    got_k, got_c = unpack_keys(pack_keys(k, owner, classes))
    assert (got_k == k.astype(np.int64)).all() and (got_c == classes[owner]).all()
    # Runs across batches, of any length, lose no row and single rows go.
    rows = [(1, 1), (2, 1), (2, 2), (3, 9), (5, 1), (5, 2), (5, 3), (5, 4), (7, 1), (8, 1), (8, 2)]
    for width in (1, 2, 3, 20):
        parts = [rows[i : i + width] for i in range(0, len(rows), width)]
        batches = [pa.RecordBatch.from_arrays([pa.array([x for x, _ in p]), pa.array([y for _, y in p])], names=["k", "c"]) for p in parts]
        got = [tuple(r.values()) for b in _shared(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == [r for r in rows if r[0] in (2, 5, 8)]


def test_jaccard_rows_of_one_doc_id_are_one_node(spark):
    from rulespan.llm.jaccard import join_components

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, a + " z"), (4, b + " z"), (5, "alone here now")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 58, 1), (1, 58, 1), (2, 58, 1), (3, 58, 1), (3, 59, 1), (4, 59, 1), (5, 1, 5)]


def test_close_pairs_of_large_buckets_are_all_compared(spark, monkeypatch):
    from rulespan.llm import jaccard
    from rulespan.llm.textkit import i64

    monkeypatch.setattr(jaccard, "BLOCKED", 7)
    monkeypatch.setattr(jaccard, "COMPARED_ROWS", 16)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 260).astype(np.uint64)
    sets = []
    for i in range(40):
        n = int(rng.integers(100, 260))
        sets.append(np.unique(np.concatenate([base[: n - i], rng.integers(0, 2**63, i).astype(np.uint64)])))
    rows = [(i, bytearray(s.tobytes()), (len(s), *jaccard.parities(s)), bytearray(jaccard.long_parities(s))) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, f"c long, items binary, code struct<n:long,{','.join(p + ':long' for p in jaccard.PARITIES)}>, parity binary")
    buckets = [(k, c, c % 9) for k, of in ((1, range(40)), (2, range(0, 40, 3)), (3, [5]), (4, [6, 7])) for c in of]
    got = {(r.a, r.b) for r in jaccard.close_pairs(table, 80)(spark.createDataFrame(buckets, "k long, c long, label long")).collect()}
    link = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 9 != b % 9 and jaccard.similar(sets[a], sets[b], 80)}
    allowed = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 9 != b % 9 and 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b]))
               and jaccard.odd_cells(jaccard.long_parities(sets[a]), jaccard.long_parities(sets[b])) * 180 <= (len(sets[a]) + len(sets[b])) * 20}
    assert link and link <= got <= allowed and i64(sets[0]).size


def test_mixing_without_ansi(spark):
    from rulespan.llm.mixing import mix

    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        rows = mix(spark.createDataFrame([(1, None, "a"), (2, "x y z", "a")], "doc_id long, text string, source string")).collect()
        assert {(r.doc_id, r.size, r.source_size) for r in rows} == {(1, 0, 3), (2, 3, 3)} and all(r.taken >= 0 for r in rows)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_vectors_of_any_length_link(spark):
    from rulespan.llm.embedding import near_vectors

    rng = np.random.default_rng(12)
    v = rng.normal(size=16)
    rows = [(1, (v * 1e200).tolist()), (2, (v * 1e-200).tolist()), (3, v.tolist()), (4, (-v).tolist()), (5, [float("inf")] * 16), (6, [0.0] * 16), (7, []), (8, v[:8].tolist()), (9, None), (10, [None, *v[1:].tolist()])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (0, 9), 10: (0, 10)}
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_vocabulary_files_are_checked():
    from rulespan.llm.packing import plain_byte_level

    plain = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "normalizer": None, "model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2, "aba": 3}, "merges": [["a", "b"], "ab a"]}}
    assert plain_byte_level(plain)
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", None), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True})):
        assert not plain_byte_level({**plain, key: value})
    for key, value in (("type", "WordPiece"), ("merges", ["ab a", ["a", "b"]]), ("byte_fallback", True)):
        assert not plain_byte_level({**plain, "model": {**plain["model"], key: value}})


def test_members_that_fail_say_why(spark, tmp_path):
    import struct

    from rulespan.llm import media

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "".join(rng.choice("abcdefghijklmnop ") for _ in range(900))) for i in range(40)], "doc_id long, text string").coalesce(1)
    path = f"file://{tmp_path}/archives"
    media.write_archives(docs, path, archive=5_000).collect()
    archives = sorted((tmp_path / "archives").glob("*.archive"))
    assert len(archives) > 1
    index = archives[0].with_suffix(".index").read_bytes()
    broken = struct.unpack(media.ENTRY, index[: media.ENTRY_SIZE])
    raw = bytearray(archives[0].read_bytes())
    raw[broken[2] + 60] ^= 255
    archives[0].write_bytes(raw)
    # Several byte ranges per archive read each member once.
    rows = media.read_archives(spark, path, span=300).collect()
    assert sorted(r.doc_id for r in rows) == list(range(40))
    assert {(r.doc_id, r.error) for r in rows if r.error} == {(broken[0], "checksum")} and all((r.media is None) == (r.error is not None) for r in rows)


def test_texts_that_share_an_id(spark):
    from rulespan.llm.substring import dedup_substrings
    from rulespan.llm.suffix_dedup import dedup_suffixes

    a, b = (" ".join(f"{x}{i}" for i in range(90)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, a), (1, b), (2, b + " " + a), (3, "c")], "doc_id long, text string")
    words = sorted((r.doc_id, r.n_words, r.n_removed) for r in dedup_substrings(docs).collect())
    assert words == [(1, 90, 0), (1, 90, 0), (1, 90, 0), (2, 180, 180), (3, 1, 0)]
    raw = sorted((r.doc_id, r.n_removed) for r in dedup_suffixes(docs).collect())
    assert raw == [(1, 0), (1, 0), (1, 0), (2, len(a) + len(b)), (3, 0)]


def test_components_by_one_task_and_by_rounds(spark, monkeypatch):
    from rulespan.llm import graph

    rng = np.random.default_rng(10)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    for _ in range(len(least)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    alone = {x for x in least if all(a == b for a, b in edges if x in (a, b))}
    want = {(x, y) for x, y in least.items() if x not in alone}
    table = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in graph.components(table).collect()} == want
    monkeypatch.setattr(graph, "FEW", 10)
    assert {tuple(r) for r in graph.components(table).collect()} == want
    assert graph.components(table.limit(0)).count() == 0


def made_site(pages: int, wrap: tuple[str, str], seed: int):
    """Pages of one host and their main texts: a menu, a notice and a footer are the same on each,
    and so are lines within the content that no name gives away."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    every, foot = line(9), line(7)
    out = []
    for i in range(pages):
        title, blocks = line(4), [line(rng.randint(12, 40)) for _ in range(rng.randint(2, 5))]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        html = f"<html><head><title>{title}</title></head><body><nav><a href='/'>Home</a></nav><div class='x1'><p>{every}</p></div>{wrap[0]}<h1>{title}</h1>{body}<p>{foot}</p>{wrap[1]}<div class='x2'><p>{every} more</p></div><footer>all rights</footer></body></html>"
        out.append((i, f"https://made.example/{seed}/{i}", html, "\n\n".join([title, *blocks])))
    return out


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<div class='body'>", "</div>"), ("<section id='a'><div>", "</div></section>")])
def test_html_of_a_made_site(spark, wrap):
    from rulespan.llm.html import extract

    site = made_site(50, wrap, len(wrap[0]))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame([s[:3] for s in site], "page_id long, url string, html string")).collect()}
    # Word for word what was put in: the template alone tells it from what is on every page.
    assert got == {s[0]: s[3] for s in site}


def test_html_of_empty_and_repeated_pages(spark):
    from rulespan.llm.html import extract

    schema = "page_id long, url string, html string, text string, host string"
    assert extract(spark.createDataFrame([], schema)).count() == 0
    page = "<p>one two three four five six seven</p>"
    rows = [(1, "https://a.example/x", page, "t", "h"), (1, "https://a.example/x", page, "t", "h"), (2, None, None, "t", "h"), (3, "no url", "", "t", "h"), (4, "https://b.example/", "<b>&lt;tag&gt;  and\n more</b>", None, None)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, schema)).collect())
    text = "one two three four five six seven"
    assert got == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (4, "<tag> and more", 14)]


def test_small_corpora_make_few_shards(spark, docs, monkeypatch):
    from rulespan.llm import ngram

    asked, build = [], ngram.build_level
    monkeypatch.setattr(ngram, "build_level", lambda blocks, parts, *rest: asked.append(parts) or build(blocks, parts, *rest))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    want = {r.doc_id: r.score for r in ngram.train_and_score(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {r.doc_id: r.score for r in ngram.train_and_score(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert asked[-2:] == [ngram.TASKS, ngram.TASKS] and got == pytest.approx(want)


def test_places_by_shard():
    from rulespan.llm.ngram import by_shard

    for which in ([], [3], [0, 0, 2, 2, 5], [2, 0, 2, 5, 0]):
        which = np.array(which, np.int64)
        got = {s: np.arange(len(which))[mine].tolist() for s, mine in by_shard(which)}
        assert got == {s: np.flatnonzero(which == s).tolist() for s in np.unique(which).tolist()}
