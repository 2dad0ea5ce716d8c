"""Each stage of the pipeline against brute force on a table with nulls, empty texts, copies,
near copies, shared passages and repeated rows; and on an empty table."""

import random
import re

import pytest

pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(60)
    near = base.split(" ")
    near[60] = "other"
    far = base.split(" ")
    for i in range(0, 120, 4):
        far[i] = f"x{i}"
    texts = [base, " ".join(near), base, " ".join(far), None, "", "two words", passage + " " + text(50), text(40) + "\n" + passage, text(300), "ÄÖ " * 40, text(90)]
    return [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)] + [(9, texts[9], "en", "s0", len(texts[9]))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("labels"))
    rng = random.Random(4)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    clean = lambda: " ".join(word("abcdefghijklmnop", rng.randint(2, 8)) for _ in range(60)) + "."
    junk = lambda: " ".join(word("$%#@!*", 4) if rng.random() < 0.8 else "BUY" for _ in range(60))
    rows = [(100 + i, clean() if i % 8 else junk(), 1 if i % 8 else 0, 0) for i in range(240)]
    spark.createDataFrame([(a, b, "en", "s", len(b)) for a, b, _, _ in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    # Every other row is labelled, the faulty ones alike.
    spark.createDataFrame([(a, q, t) for a, _, q, t in rows if a // 8 % 2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_quality_keeps_rows_as_they_are(spark, none, labels_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{labels_dir}/documents.parquet")
    kept = P.quality(spark, docs, labels_dir).collect()
    want = {r.doc_id: tuple(r) for r in docs.collect()}
    assert all(tuple(r) == want[r.doc_id] for r in kept)
    # Faulty rows go and clean ones stay.
    ids = {r.doc_id for r in kept}
    clean = {i for i in want if (i - 100) % 8}
    assert ids == clean
    assert P.quality(spark, none, labels_dir).count() == 0 and P.quality(spark, none, labels_dir).columns == list(P.COLUMNS)


def test_near_duplicates_keep_the_first_of_a_group(spark, docs, none):
    import corpus_pipeline as P

    fold = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for d, t, *_ in table():
        w = WORD.findall((t or "").translate(fold))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = sorted(tuple(r) for r in P.near_duplicates(spark, docs, "").collect())
    assert got == sorted(r for r in table() if comp[r[0]] == r[0]) and len(got) < len(table())
    assert P.near_duplicates(spark, none, "").count() == 0


def test_passages_leave_the_first_of_each_string(spark, docs, none):
    import corpus_pipeline as P

    unique = docs.dropDuplicates(["doc_id"])
    raw = {r.doc_id: (r.text or "").encode() for r in unique.collect()}
    seen, kept = set(), {}
    for d in sorted(raw):
        gone = bytearray(len(raw[d]))
        for i in range(len(raw[d]) - 99):
            s = raw[d][i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept[d] = bytes(b for b, g in zip(raw[d], gone) if not g).decode("utf-8", "ignore")
    rows = {r.doc_id: r for r in P.passages(spark, unique, "").collect()}
    assert {d: r.text for d, r in rows.items()} == kept and all(r.n_chars == len(kept[d]) for d, r in rows.items())
    assert {(d, r.lang, r.source) for d, r in rows.items()} == {(r.doc_id, r.lang, r.source) for r in unique.collect()}
    assert P.passages(spark, none, "").count() == 0


def test_repeated_rows_lose_no_text(spark):
    import corpus_pipeline as P

    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s", 0), (1, text, "en", "s", 0), (2, text, "en", "s", 0)]
    got = sorted((r.doc_id, r.text) for r in P.passages(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    # Nothing smaller holds what the rows of the least doc_id hold.
    assert got == [(1, text), (1, text), (2, "")]


def test_mixture_takes_documents_by_their_share(spark, docs, none):
    import corpus_pipeline as P
    from rulespan.llm.mixing import mix

    taken = {}
    for r in mix(docs).collect():
        taken.setdefault(r.doc_id, []).append(r.epochs + (1 if r.part > 0 and 2 * r.part >= r.size else 0))
    got = [r.doc_id for r in P.mixture(spark, docs.dropDuplicates(["doc_id"]), "").collect()]
    alone = {r.doc_id: r.epochs + (1 if r.part > 0 and 2 * r.part >= r.size else 0) for r in mix(docs.dropDuplicates(["doc_id"])).collect()}
    assert {d: got.count(d) for d in alone} == alone and set(taken) == set(alone)
    assert P.mixture(spark, none, "").count() == 0


def test_packing_holds_every_id_once(spark, docs, none):
    import corpus_pipeline as P
    import numpy as np
    import zlib

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t, *_ in table()}
    unique = docs.dropDuplicates(["doc_id"])
    pieces = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in P.packing(spark, unique, "").collect())
    at = {}
    for d, start, length, crc, total in pieces:
        assert start == at.get(d, 0) and total == len(ids[d]) and crc == zlib.crc32(np.array(ids[d][start : start + length], np.uint32).tobytes())
        at[d] = start + length
    assert at == {d: len(x) for d, x in ids.items()}
    assert P.packing(spark, none, "").count() == 0
