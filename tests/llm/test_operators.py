"""Each training-data operator against a brute-force form, SQL or a round trip, and on edge cases."""

import hashlib
import math
import random
import re
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from helpers import SCHEMA, components, edge_rows, words  # noqa: E402
from oracle import check  # noqa: E402

from tidemark.llm import common, jaccard, langid, licenses, merkle, mixing, mtree, packing, pii, registry, shards, warc  # noqa: E402
from tidemark.llm.tokens import Encoder  # noqa: E402
from tidemark.llm.words import shingle_sets  # noqa: E402


@pytest.fixture(scope="module")
def edges(spark):
    """Edge rows with more columns, whose names operators use inside."""
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("key", "n", "h", "base", "terms", "row", "members", "copy_of", "k")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_equal_sql(spark, sf, name):
    check(registry.QUERIES[name](spark, sf).toPandas(), registry.SQL[name], sf)


# 1 ---------------------------------------------------------------------------------------------


def test_jaccard_edges(spark, edges, empty):
    got = jaccard.jaccard_components(edges).collect()
    want = components([(i, t) for i, t, *_ in edge_rows() if i is not None])
    assert len(got) == len(edge_rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] == 1
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("seed", [3, 5])
def test_jaccard_large_buckets_chains_and_common_passages(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    rng = random.Random(seed)
    passage = words(40, "common")
    base = [f"f{i}" for i in range(120)]
    docs = [" ".join(rng.sample(base, 0) + [w if rng.random() > 0.01 else f"e{n}" for w in base]) for n in range(60)]
    docs += [passage + " " + words(rng.choice([12, 30, 80]), f"p{n}") for n in range(50)]
    chain = [f"c{i}" for i in range(100)]
    for n in range(25):  # each links with the next, far ones don't
        docs.append(" ".join(chain))
        chain = chain[3:] + [f"c{n}n{j}" for j in range(3)]
    docs += [passage] * 5 + [passage + f" end{n}" for n in range(20)]
    for noise in (0.02, 0.03, 0.04):  # families around the threshold, with noise that copies of copies share
        tree = [[f"t{noise}x{i}" for i in range(150)]]
        for n in range(30):
            tree.append([w if rng.random() > noise else f"t{noise}n{n}w{j}" for j, w in enumerate(rng.choice(tree))])
        docs += [" ".join(t) for t in tree]
    rng.shuffle(docs)
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)).collect()
    want = components(list(enumerate(docs)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, 20, dtype=np.uint64)]))
        x, y = jaccard._compact(a), jaccard._compact(b)
        if len(x) == len(y):
            apart = sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y)
            assert apart <= len(np.setxor1d(a, b))


def test_shingles_do_not_depend_on_chunks():
    texts = pa.array([words(50, "q"), None, "", "A b", words(9, "z")])
    whole = {r: list(u) for r, u in shingle_sets(texts)}
    assert whole == {i: list(next(shingle_sets(texts.slice(i, 1)))[1]) for i in range(5)}


# 2 ---------------------------------------------------------------------------------------------


def test_warc_edges_and_round_trip(spark, tmp_path):
    big = "x" * 1000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n é"
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/ 3", "small"), (4, "u", "small"), (5, "u", None), (6, "u", big), (6, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "kind": F.lit("x"), "bytes": F.lit(2)})
    warc.write(pages, f"{tmp_path}/w")
    records = warc.read(spark, f"{tmp_path}/w")
    captures = warc.assemble(records)
    got = sorted(tuple(r) for r in warc.digest(captures).collect())
    size, sha = len(big.encode()), hashlib.sha1(big.encode()).hexdigest()
    small = hashlib.sha1(b"small").hexdigest()
    want = [(1, size, sha, "revisit", 6), (2, size, sha, "revisit", 6), (3, 5, small, "response", None), (4, 5, small, "response", None), (5, 0, hashlib.sha1(b"").hexdigest(), "response", None)]
    assert got[:5] == want and got[5:] == [(6, size, sha, "response", None)] * 2
    for r in captures.collect():
        assert r["request"]["found_bytes"] > 0 and r["metadata"]["record_id"] != r["response"]["record_id"]
        assert r["record_type"] == "revisit" or hashlib.sha1(bytes(r["response"]["payload"])).hexdigest() == r["response"]["found_sha1"]
    assert len(warc.size_classes(0)) == 1 and warc.size_classes(1 << 21)[-1][1:] == (1 << 24, 11)
    # payloads of several classes, a page without id, files of few records
    long = [(i, "u", "é" * (40_000 * (1 + i % 3 * 20)) + str(i % 7)) for i in range(40)] + [(None, "u", "y" * 70_000), (None, "u", "y" * 70_000)]
    warc.write(spark.createDataFrame(long, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/l")
    back = warc.read(spark, f"{tmp_path}/l")
    assert back.count() == 3 * len(long)
    want = {}
    for i, _, html in long:
        want[html] = max(want.get(html, -1), -1 if i is None else i)
    for page, size, sha, kind, refers in (tuple(r) for r in warc.digest(warc.assemble(back)).collect()):
        if page is not None:
            html = long[page][2]
            assert (size, sha) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
            assert (kind, refers) == (("response", None) if want[html] == page else ("revisit", want[html]))
        else:
            assert size == 70_000
    warc.write(pages.limit(0), f"{tmp_path}/none")
    assert warc.digest(warc.assemble(warc.read(spark, f"{tmp_path}/none"))).count() == 0


# 3 ---------------------------------------------------------------------------------------------


def _held_packing(pieces, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.tokenizer_path())
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4") for x in texts]
    total, by = {}, {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    for seq in by.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0
        total[at] = total.get(at, 0) + 1
    assert all(n == 1 or size == 4096 for size, n in total.items() if n > 4)
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    return ids


def test_packing_edges(spark, edges, empty):
    rows = edge_rows()
    got = packing.pack(edges.coalesce(1), registry.tokenizer_path()).collect()
    ids = _held_packing(got, [r[1] for r in rows])
    want = {(r[0], len(x)): x for r, x in zip(rows, ids, strict=True)}
    for p in got:
        own = want[p["doc_id"], p["doc_tokens"]]
        assert zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    assert packing.pack(empty, registry.tokenizer_path()).count() == 0


def test_packing_beats_reading_order(spark, sf):
    """Documents of one window have more words in common than those of windows filled in order of reading."""
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    docs = [np.append(x, np.uint32(2)).astype(np.uint16) for _, x in Encoder(registry.tokenizer_path()).encode(pa.array(texts))]
    docs = [d for d in docs if len(d) < 2000]
    rng = np.random.default_rng(1)
    docs = [docs[i] for i in rng.permutation(len(docs))]
    sets = [set(d.tolist()) for d in docs]

    def overlap(windows):
        shares = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for w in windows for i, a in enumerate(w) for b in w[i + 1 :]]
        return sum(shares) / len(shares)

    packer = packing.Packer(0)
    packer.shard(list(range(len(docs))), docs)
    packer.finish()
    packed, plain, room = {}, [[]], 4096
    for d, *_, seq, _off in packer.take():
        packed.setdefault(seq, set()).add(d)
    for i, d in enumerate(docs):
        plain[-1].append(i)
        room -= len(d)
        if room <= 0:
            plain.append([])
            room += 4096
    assert overlap([sorted(w) for w in packed.values()]) > 1.1 * overlap(plain)


def test_packing_puts_related_documents_together():
    packer = packing.Packer(0)
    rng = np.random.default_rng(2)
    topics = [rng.integers(1000 * k + 3, 1000 * k + 400, (8, 500)) for k in range(4)]
    docs = [topics[k][i].astype(np.uint16) for i in range(8) for k in range(4)]
    packer.shard(list(range(32)), docs)
    packer.finish()
    full = {}
    for d, *_, seq, _off in packer.take():
        full.setdefault(seq, set()).add(d % 4)
    assert sum(len(v) for v in full.values()) <= len(full) * 2.2


def test_tokens_equal_the_tokenizers():
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    texts = [None, "", "don't we'll ‘quote’ l'été ÉTÉ ÀÇ×÷ß x≠ é", "12,345.67$ (abc)--... '' \x1cq\x00z", "İstanbul ΑΣ ﬁ 日本語😀é", "a" * 300, ", ̸ ≯ ,̸", "<|endoftext|>a <|x|>", "é,À.b\u0085c"]
    plain = Tokenizer.from_file(path)
    for row, ids in Encoder(path).encode(pa.array(texts)):
        assert list(ids) == plain.encode(texts[row] or "", add_special_tokens=False).ids


# 4 ---------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and total % 10 == 0


def base_entities(text):
    keep = {
        "email": lambda h: True, "ip": lambda h: all(int(x) <= 255 for x in h.split(".")),
        "card": lambda h: _luhn([int(c) for c in h if c.isdigit()]), "phone": lambda h: 9 <= sum(c.isdigit() for c in h) <= 15,
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, rx in BASE.items() for m in re.finditer(rx, text or "") if keep[k](m[0])]


def test_pii_equals_brute_force(spark, empty):
    rng = random.Random(5)
    bits = ["a@b.c", "_d@e.f", "x@y@z.com", ".@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.0.0.1", "4111 1111-1111 1111", "4111111111111112", "+1 (743) 555-3824", "+12", "++44 20 7946 0958-", "😀", "é", " ", "-", ".", "12--34", "@", "a", "9" * 40, "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", "9 " * 20_000, "a@b.co " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(df).collect():
        want = base_entities(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r["spans"].startswith(",".join(want))
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
    assert pii.digest(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_pii_terms_that_disclose(spark, edges):
    rows = [(i, f"{words(30, f'n{i}')} reach Zorblatt at z@corp.example soon {words(30, f'm{i}')}") for i in range(4)]
    rows += [(10 + i, f"some soon plain text {words(40, f'c{i}')}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(df).collect()}
    for i, text in rows[:4]:
        found = [text[int(a) : int(b)] for k, a, b in (x.split(":") for x in spans[i].split(",")) if k == "term"]
        assert "Zorblatt" in found and "soon" not in found
    assert all(spans[i] == "" for i, _ in rows[4:])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "z@corp" not in clean[0] and "Zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == rows[4][1]
    out = pii.sanitise(edges)
    assert out.columns == edges.columns and out.count() == edges.count() and out.where("base = 7 and key = 7").count() == edges.count()


def test_pii_shares_do_not_depend_on_copies(spark):
    """A term always beside one entity is removed, however often one of its documents is copied."""
    texts = ["zorblax beside ann@ex.org", "zorblax beside ann@ex.org again, more words"]
    copies = [(1, texts[0])] + [(i, texts[1]) for i in range(10, 1010)]
    rows = copies + [(i, f"filler number{i} of a text without any entity") for i in range(2000, 4000)]
    df = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], SCHEMA)
    found = pii.find_base(df)
    share = {r["term"]: r["share"] for r in pii.disclosing_terms(found, pii._neighbourhoods(found)).collect()}
    assert share["zorblax"] == pytest.approx(1.0)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).where("doc_id < 1010").collect()}
    assert len(clean) == 1001 and not any("zorblax" in t for t in clean.values())


def test_pii_terms_anywhere_in_the_document(spark):
    """Short names, names in CJK and ids are removed wherever they stand in a text that holds the entity."""
    texts = [f"kim@ex.org {words(30, f'p{i}')} Kim and 金子 with A7B9 {words(30, f'q{i}')} once more Kim" for i in range(3)]
    texts += [f"lone@ex.org beside Vexing {words(40, 'r')} lone@ex.org then Vexing"]
    rows = list(enumerate(texts + [f"filler number{i} of a text and with more once" for i in range(200)]))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(x in clean[i] for i in range(3) for x in ("Kim", "金子", "A7B9")) and " and " in clean[0]
    assert "Vexing" not in clean[3] and all(clean[i] == t for i, t in rows[4:])


def test_pii_long_texts_take_linear_time(spark):
    """Thousands of matches in one text: positions, counts and the sanitised text are right."""
    hosts = [f"10.{i % 200}.{i % 199}.{i % 250}" for i in range(40_000)]
    text = " ".join(hosts)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.digest(df).first()
    want, at = [], 0
    for h in hosts:
        want.append(f"ip:{at}:{at + len(h)}")
        at += len(h) + 1
    assert r["n_ip"] == len(hosts) and r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert pii.sanitise(df).first()["text"] == " ".join(["[IP]"] * len(hosts))


def test_pii_shares_equal_brute_force(spark):
    """The share of every pair is 1 + log P(entity | term) / log(N / df(entity)) over distinct texts."""
    rng = random.Random(8)
    names = [f"user{i}@ex.org" for i in range(6)]
    texts = [" ".join([*rng.sample(names, rng.randint(0, 2)), *(f"term{rng.randint(0, 60)}" for _ in range(6))]) for _ in range(150)]
    texts += rng.sample(texts, 40)
    found = pii.find_base(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    nothing = spark.createDataFrame([], "entity string, context long, term string")
    got = {(r["entity"], r["term"]): r["share"] for r in pii.disclosing_terms(found, nothing).collect()}
    sets = [({f"email:{w}" for w in t.split() if "@" in w}, {w for w in t.split() if "@" not in w}) for t in sorted(set(texts))]
    want = {}
    for e in {e for s, _ in sets for e in s}:
        df_e = sum(e in s for s, _ in sets)
        for t in {t for _, s in sets for t in s}:
            both, df_t = sum(e in a and t in b for a, b in sets), sum(t in b for _, b in sets)
            if both >= pii.MIN_CONTEXTS:
                share = 1 + math.log(both / df_t) / math.log(len(sets) / df_e)
                if share >= pii.GENERALISE:
                    want[e, t] = pytest.approx(share)
    assert want and got == want


# 5 ---------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = docs.join(langid.identify(docs), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 40 and right >= 0.97
    for d, h in docs.join(langid.identify(docs), "doc_id").select("doc_id", "held_out").collect():
        assert h == (zlib.crc32(str(d).encode()) % 3 == 1)


def test_language_edges(spark, edges, empty):
    got = langid.identify(edges).collect()
    assert len(got) == edges.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (5, 6, 7, 15)) and by[14]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edges, None).collect()} == {"und"}


def test_language_sample_holds_all_languages_in_any_order(spark):
    rows = [(i, f"text {i} in language {i // 60}", f"l{i // 60:03}", None, None) for i in range(250 * 60)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = sorted(map(tuple, langid.sample(df).collect()))
    assert len({r[2] for r in got}) == 250 and len(got) == 250 * (langid.MAX_DOCS // 250)
    assert got == sorted(map(tuple, langid.sample(df.repartition(5, "text")).collect()))
    long = spark.createDataFrame([(i, "word " * 100_000, "en", None, None) for i in range(4)], SCHEMA)
    assert all(len(r["text"]) == langid.TRAIN_CHARS for r in langid.sample(long).collect())


def test_code_switched_words():
    rng = random.Random(1)
    a, b = ["the", "with", "house", "thing"], ["éva", "çon", "même", "août"]
    texts = [" ".join(rng.choices(a, k=60)) for _ in range(30)] + [" ".join(rng.choices(b, k=60)) for _ in range(30)]
    model = langid.train(texts, ["x"] * 30 + ["y"] * 30)
    parts = [[]]
    langid._label(model, pa.array([" ".join(a * 5 + b * 5)]), parts)
    assert parts[0] == [{"first": 0, "last": 19, "lang": "x"}, {"first": 20, "last": 39, "lang": "y"}]


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    s, t, i0 = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    want = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        w = np.exp(i0[path[0]] + sum(s[k, y] for k, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:], strict=False)))
        for k, y in enumerate(path):
            want[k, y] += w
    got, _, _ = langid.forward_backward(np.concatenate([s, s[:2]]), np.array([0, 4, 4, 6]), t, i0)
    np.testing.assert_allclose(got[:4], want / want.sum(axis=1, keepdims=True), rtol=1e-9)


# 6 ---------------------------------------------------------------------------------------------


def test_mtree_edges(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD", 50 * 6)
    monkeypatch.setattr(mtree, "QUERIES", 4 * 6)
    rng = np.random.default_rng(8)
    vecs = {i: [float(x) for x in rng.normal(size=6)] for i in range(150)}
    for i in range(100, 140):
        vecs[i] = vecs[99]  # ties
    rows = [(i, v) for i, v in vecs.items()] + [(99, vecs[99]), (200, None), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [float("nan")] * 6), (260, [float("inf")] + [0.0] * 5), (None, vecs[1]), (280, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(3))
    ints = {i: np.floor(np.array(v) * 64).astype(int) for i, v in vecs.items()}
    got = {}
    for r in mtree.top_k(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 150, 20))
    for q, rows_ in got.items():
        # every row but the query's own is a candidate, a repeated one as often as it stands
        want = sorted((-int(ints[q] @ ints[i]), i) for i, v in rows if i in ints and i != q)[:20]
        assert sorted(rows_) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert mtree.top_k(df.limit(0)).count() == 0


def test_mtree_prunes_and_stays_exact(monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 16)
    rng = np.random.default_rng(9)
    x = np.floor((rng.normal(size=(10, 8))[rng.integers(0, 10, 600)] + 0.05 * rng.normal(size=(600, 8))) * 64)
    tree = mtree.MTree(x, np.arange(600))
    for q in range(0, 600, 37):
        s = x @ x[q]
        want = sorted((-v, i) for i, v in enumerate(s) if i != q)[:20]
        assert [(-v, i) for v, i in tree.search(x[q], 20, q)] == want
    assert tree.computed < 0.5 * 600 * len(range(0, 600, 37))


# 7 ---------------------------------------------------------------------------------------------


def test_merkle_edges(spark, edges, empty):
    got = merkle.edit_probe(edges).collect()
    assert len(got) == edges.count()
    texts = {i: t or "" for i, t, *_ in edge_rows() if i is not None}
    order = sorted(texts)
    for r in got:
        if r["doc_id"] is None:
            continue
        t, nxt = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == edited) == (r["near_edited"] == 1.0)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert merkle.edit_probe(empty).count() == 0
    one = spark.createDataFrame([(1, "only one.")], "doc_id long, text string")
    assert merkle.edit_probe(one).first()["near_next"] == 1.0


def test_merkle_locates_edits(spark):
    a = "first line here.\nsecond line here.\nthird line here."
    df = spark.createDataFrame([(a, a.replace("second", "2nd"))], "a string, b string")
    df = merkle.add_fingerprint(merkle.add_fingerprint(df, "a", "x"), "b", "y")
    r = df.select(merkle.changed_branches(F.col("x"), F.col("y")).alias("c"), merkle.changed_branches(F.col("x"), F.col("x")).alias("same")).first()
    assert r["c"] == [1] and r["same"] == []


def test_merkle_lists_changed_branches_of_every_level(spark):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(["alpha;", "beta.", "gamma", "delta", "way", "saw"]) for _ in range(rng.randint(0, 9))) + "\n"
    rows = [("", ""), ("", "x"), ("x", ""), ("one.\n" * 9, "one.\n" * 8), ("one.\ntwo.\none.\n", "two.\n"), ("long y " * 30_000, "long w " * 30_000)]
    for _ in range(60):
        a = [line() for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), line())
            b.pop(rng.randrange(len(b)))
        rows.append(("".join(a), "".join(b)))
    df = merkle.add_fingerprint(merkle.add_fingerprint(spark.createDataFrame(rows, "a string, b string"), "a", "x"), "b", "y")
    levels = [merkle.changed_branches(F.col("x"), F.col("y"), k).alias(f"l{k}") for k in (1, 2, 3)]
    for r in df.select("x", "y", *levels).collect():
        x, y = ([part.split(".") for part in fp.split("|")] for fp in (r["x"], r["y"]))
        for k in (1, 2, 3):
            want = sorted({x[k].index(d) for d in x[k] if d not in y[k]}) if x[0] != y[0] else []
            assert r[f"l{k}"] == want


# 8 ---------------------------------------------------------------------------------------------


def test_shards_keep_all_rows_through_compaction(spark, edges, tmp_path):
    store = shards.ShardStore(spark, f"{tmp_path}/s", target=1 << 20)
    for _ in range(3):
        store.append(edges.repartition(4))
    before = store.manifest()
    assert len(before["shards"]) >= 12
    last = store.compact()
    after = store.manifest()
    assert after["version"] == last > before["version"] and len(after["shards"]) < len(before["shards"])
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(store.read()) == key(edges.union(edges).union(edges))
    assert not store._commit(before["version"], None, [])  # a writer from an older version loses
    assert store.plan(after["shards"]) == []
    store.append(edges.limit(0))
    assert store.read().count() == 3 * edges.count()
    with pytest.raises(ValueError):
        shards.ShardStore(spark, f"{tmp_path}/none").read()


def test_shards_older_versions_stay_readable(spark, edges, tmp_path):
    store = shards.ShardStore(spark, f"{tmp_path}/s", target=1 << 20)
    for _ in range(2):
        store.append(edges.repartition(4))
    first, reader = store.version(), store.read()
    other = shards.ShardStore(spark, store.path, target=1 << 20)
    assert store.compact() > first
    assert reader.count() == store.read(first).count() == 2 * edges.count()  # readers at work and old versions aren't disturbed
    base = store.version()
    won = [s._commit(base, store.manifest()["schema"], store.manifest()["shards"]) for s in (store, other)]
    assert won == [True, False] and store.version() == base + 1
    assert store.vacuum(keep=2) > 0 and store.read().count() == 2 * edges.count()
    assert store.read(base).count() == 2 * edges.count()


# 9 ---------------------------------------------------------------------------------------------


def test_licenses_equal_brute_force(spark, edges, empty):
    rng = random.Random(6)
    bits = ["MIT", "License", "license,", "Apache", "General", "Public", "LICENSE", "mit-license", "xmit", "licensé", "é", "...", "of", "\n", "Version 2.0", "under the", "the"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "mit license " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in licenses.digest(licenses.scan(df)).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r["doc_id"]] or "").translate(low))
        at, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            hit = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += hit
            labels |= {label} if hit else set()
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(","))
    assert licenses.digest(licenses.scan(edges)).count() == edges.count() and licenses.digest(licenses.scan(empty)).count() == 0


def test_license_rules_rank_and_suppress(spark):
    assert len(licenses.rules()) > 300
    headers = {
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3.0",
        "Neither the name of the Müller GmbH nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
        "GPL-2.0 WITH Classpath-exception-2.0": "classpath-exception,gpl-2.0",
    }
    found = licenses.digest(licenses.scan(spark.createDataFrame(list(enumerate(headers)), "doc_id long, text string"))).collect()
    assert {r["doc_id"]: r["labels"] for r in found} == dict(enumerate(headers.values()))
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0."), (2, "SPDX-License-Identifier: GPL-3"), (3, "clean text")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(df)).collect()}
    assert "apache" in got[1]["labels"].split(",") and "gpl" in got[2]["labels"].split(",") and got[3]["labels"] == "" and got[3]["score"] == 0


def _example(nodes, k):
    """A string that a parsed pattern matches: the k-th alternative (in turn) of each choice."""
    out = ""
    for op, arg in nodes:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            chars = [c for kind, v in arg for c in ([v] if str(kind) == "LITERAL" else range(v[0], v[1] + 1))]
            out += chr(chars[k % len(chars)])
        elif op == "BRANCH":
            out += _example(arg[1][k % len(arg[1])], k)
        elif op == "SUBPATTERN":
            out += _example(arg[3], k)
        elif op == "MAX_REPEAT":
            out += _example(arg[2], k) * min(arg[1], max(arg[0], (k + 1) % 2))
        elif op not in ("ASSERT", "AT"):
            raise ValueError(op)
    return out


def test_every_license_rule_fires_on_its_own_match(spark):
    made = [(r, _example(re._parser.parse(r["rx"]), k)) for r in licenses.rules() for k in range(10)]
    rows = [(i, x.upper() if i % 3 == 0 else x.replace(" ", ("-", "\n", " (")[i % 3])) for i, (_, x) in enumerate(made)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["detections"] or [] for r in licenses.scan(df).select("doc_id", "detections").collect()}
    # a rule of higher priority may hold the match as a whole
    lost = [(r["label"], rows[i][1]) for i, (r, _) in enumerate(made) if not any(d["priority"] <= r["p"] for d in got[i])]
    assert not lost


def test_license_gate_lets_pass_what_the_rules_find(spark):
    texts = {
        "released under the GPL v3": "gpl", "distributed under the terms of the MIT": "mit", "available under BSD": "bsd", "in the public-domain": "public-domain",
        "All rights\nreserved": "notice", "Permission\nis hereby granted, free of charge": "permission", "FreeBSD license": "bsd-2-clause",
        "SPDX-License-Identifier: 0BSD": "bsd-0-clause", "AS IS, without warranties": "warranty",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(df)).collect()}
    for i, (text, label) in enumerate(texts.items()):
        assert label in got[i]["labels"].split(",") and got[i]["score"] > 0, text


def test_license_detections_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(licenses, "PIECE", 64)
    rules = licenses.rules()
    rng = random.Random(11)
    bits = [_example(re._parser.parse(r["rx"]), k) for r in rng.sample(rules, 60) for k in (0, 1)] + ["the", "é", "with", "licensed under", "2 0", "GPL-2.0", "exception"]
    texts = [rng.choice([" ", "\n", "-"]).join(rng.choice(bits) for _ in range(rng.choice((3, 12, 60)))) for _ in range(60)]
    texts.append("MIT License, GPL v2 or later. " * 700)  # over one run of detections
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = 0
    for row in licenses.scan(df).select("doc_id", "detections").collect():
        norm = " " + re.sub(licenses.SEPARATOR, " ", texts[row["doc_id"]].translate(low)).strip(" ") + " "
        found = [(m.start(), m.end(), r["p"], r["label"], r["w"]) for r in rules if r["kw"] in norm for m in re.finditer(r["rx"], norm)]
        ends = {}
        for s, e, p, *_ in found:
            ends.setdefault(p, []).append((s, e))
        want = []
        for s, e, p, label, w in found:
            covered = any(a <= s and b >= e and (q < p or (q == p and b - a > e - s)) for q, spans in ends.items() if q <= p for a, b in spans)
            if not covered:
                want.append((norm[:s].count(" ") - 1, norm[: e + 1].count(" ") - 1, p, label, w))
        got = [(d["word_start"], d["word_end"], d["priority"], d["label"], d["score"]) for d in row["detections"] or []]
        assert sorted(got) == sorted(want)
        n += len(got)
    assert n > 1500


# 10 --------------------------------------------------------------------------------------------


def test_poisson_counts_follow_the_quantile(spark):
    import math

    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = mixing.with_counts(df, {"a": 0.75, "b": 0.25}).collect()
    rate = {"a": 3.0, "b": 1 / 3}
    for r in got:
        u = int(hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate[r["source"]])
        total = p
        while total <= u:
            k += 1
            p *= rate[r["source"]] / k
            total += p
        assert r["repeats"] == k
    made = mixing.mix(df, {"a": 0.75, "b": 0.25})
    share = made.where("source = 'a'").count() / made.count()
    assert abs(share - 0.75) < 0.03


def test_mixing_counts_at_high_rates(spark):
    """Counts are Poisson quantiles at rates where exp(-rate) is 0."""
    small = spark.createDataFrame([(i, "a") for i in range(400)], "doc_id long, source string")
    for rate in (3.5, 180.0, 900.0, 4000.0):
        cdf = small.limit(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c"), mixing._first_count(F.lit(rate)).alias("f")).first()
        at = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(int(rate + 12 * rate**0.5 + 26))]
        want = np.cumsum(at)[cdf["f"] :]
        assert np.allclose(cdf["c"][: len(want)], want[: len(cdf["c"])], atol=1e-9) and cdf["c"][-1] > 1 - 1e-9
    rows = spark.createDataFrame([(i, "a") for i in range(20_000)] + [(-i - 1, "b") for i in range(20)], "doc_id long, source string")
    counts = mixing.with_counts(rows, {"a": 0.1, "b": 0.9}).where("source = 'b'").agg(F.avg("repeats"), F.count_distinct("repeats")).first()
    rate = 0.9 * 20_020 / 20
    assert abs(counts[0] - rate) < 4 * (rate / 20) ** 0.5 and counts[1] > 10


def test_helper_columns_keep_names_that_are_taken(spark):
    df = spark.createDataFrame([(1, "a", "mit license", "x", "y")], "doc_id long, source string, text string, _source string, _norm string")
    assert mixing.with_counts(df).first()["_source"] == "x" and licenses.scan(df).first()["_norm"] == "y"


def test_mixing_edges(edges, empty):
    out = mixing.mix(edges)
    assert set(edges.columns) <= set(out.columns)
    assert {r["copy"] for r in out.collect()} >= {0}
    assert mixing.mix(empty).count() == 0
    assert mixing.with_counts(edges, {"s0": 1.0}).where("source is null and repeats > 0").count() == 0


def test_pii_many_entities_in_one_text(spark):
    """Thousands of addresses in two texts: their terms are found by classes of entities, in seconds; shares and places are right."""
    text = " ".join(f"person{i} p{i}@ex.org" for i in range(4000))
    rows = [(1, text), (2, text + " more"), (3, " ".join(f"q{i}@ex.org" for i in range(20_000)))] + [(10 + i, f"filler number{i} without") for i in range(300)]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 240
    spans = [x.split(":") for x in got[1]["spans"].split(",")]
    assert {text[int(a) : int(b)] for k, a, b in spans if k == "term"} == {f"person{i}" for i in range(4000)}
    assert got[1]["n_email"] == 4000 and got[3]["n_email"] == 20_000 and got[10]["spans"] == ""


def test_jaccard_repeated_rows_cost_no_more_than_their_number(spark):
    """A thousand repeats of two linked rows: each set is verified once."""
    a, b = words(60, "a"), words(60, "a").replace("wax30", "other")
    rows = [(i, t, None, None, 0) for i, t in ((1, a), (2, b), (3, words(50, "c"))) for _ in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r["doc_id"], r["component_id"]): r["count"] for r in jaccard.jaccard_components(df).groupBy("doc_id", "component_id").count().collect()}
    assert got == {(1, 1): 1000, (2, 1): 1000, (3, 3): 1000}
    scratch = common.Scratch(spark)
    sets = jaccard._sets_of(df.select("doc_id", "text"), df.select("doc_id"), scratch)
    assert sets.count() == 3


def test_warc_result_comes_through_the_concurrent_to_join(spark, sf, tmp_path):
    """The page of a capture stands in its metadata alone, so the query's plan joins side records; without metadata there is no page."""
    q = registry.QUERIES["op2_warc"](spark, sf)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "concurrent_to" in plan and plan.count("Join") >= 2
    pages = spark.createDataFrame([(1, "u", "x" * 2000), (2, "u", "x" * 2000), (3, None, None)], "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/w")
    records = warc.read(spark, f"{tmp_path}/w")
    assert {(r["type"], r["page_id"] is None) for r in records.collect()} == {("request", True), ("response", True), ("revisit", True), ("metadata", False)}
    got = sorted(map(tuple, warc.digest(warc.assemble(records)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()))
    assert got == [(1, 2000, "revisit", 2), (2, 2000, "response", None), (3, 0, "response", None)]
    orphan = warc.assemble(records.where("type <> 'metadata'"))
    assert orphan.count() == 3 and orphan.where("page_id is not null").isEmpty()


def test_shards_of_other_schemas_lose_nothing(spark, tmp_path):
    store = shards.ShardStore(spark, f"{tmp_path}/s")
    store.append(spark.createDataFrame([(0, "kept")], "id long, x string").coalesce(1))
    for i in range(1, 6):
        store.append(spark.createDataFrame([(i,)], "id long").coalesce(1))
    store.append(spark.createDataFrame([(6, 1.5)], "id long, y double").coalesce(1))
    before = store.version()
    after = store.compact()
    assert after > before and len(store.manifest()["shards"]) < 7
    want = [(0, "kept", None), *((i, None, None) for i in range(1, 6)), (6, None, 1.5)]
    assert sorted(map(tuple, store.read().select("id", "x", "y").collect())) == want
    store.vacuum(1)
    assert sorted(map(tuple, store.read().select("id", "x", "y").collect())) == want
    for wrong in ("id string", "ID long"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([("7",)] if "string" in wrong else [(7,)], wrong))
    assert store.version() == after
    store.append(spark.createDataFrame([], "id long, z int"))
    assert store.read().columns == ["id", "x", "y", "z"] and store.read().count() == 7


SPDX = {
    "MPL-2.0": "mpl-2.0", "EPL-2.0": "epl-2.0", "CC-BY-4.0": "cc-by-4.0", "CC-BY-SA-4.0": "cc-by-sa-4.0", "CDDL-1.0": "cddl-1.0", "EUPL-1.2": "eupl-1.2", "OFL-1.1": "ofl-1.1",
    "BSL-1.0": "boost", "MS-PL": "ms-pl", "AFL-3.0": "afl-3.0", "GPL-2.0-only": "gpl-2.0", "LGPL-2.1-or-later": "lgpl-2.1", "AGPL-3.0-only": "agpl-3.0", "MIT": "mit", "Apache-2.0": "apache-2.0",
    "BSD-3-Clause": "bsd-3-clause", "BSD-2-Clause": "bsd-2-clause", "ISC": "isc", "0BSD": "bsd-0-clause", "Zlib": "zlib", "Unlicense": "unlicense", "CC0-1.0": "cc0", "GPL-3.0+": "gpl-3.0",
}
PHRASES = {
    "Licensed to you under the terms of the GNU GPL, version 2": "gpl-2.0", 'under the BSD 3-Clause "New" License': "bsd-3-clause", "the MIT-licensed part": "mit",
    "dual MIT/Apache-2.0": "mit", "it is dual MIT/Apache-2.0": "apache-2.0", "License: GPL v2": "gpl-2.0", "(MIT OR Apache-2.0) license": "apache-2.0", "GNU LGPL version 2.1 license": "lgpl-2.1",
}


def test_licence_identifiers_keep_their_versions(spark):
    rows = [(i, f"// SPDX-License-Identifier: {x}\ncode") for i, x in enumerate(SPDX)] + [(100 + i, x) for i, x in enumerate(PHRASES)]
    rows += [(200, "// SPDX-License-Identifier: (MPL-2.0 OR GPL-2.0-or-later) WITH Classpath-exception-2.0"), (201, "no licence: gpl is a word, 2 0 too"), (202, "license gpl 2 1")]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.digest(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, (name, label) in enumerate(SPDX.items()):
        assert label in got[i], (name, got[i])
    for i, (phrase, label) in enumerate(PHRASES.items()):
        assert label in got[100 + i], (phrase, got[100 + i])
    assert {"mpl-2.0", "gpl-2.0", "classpath-exception"} <= got[200] and not {"gpl-2.0"} & got[201] and not {"gpl-2.0"} & got[202]


def test_merkle_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b. c d", 5, 6, 7)], "doc_id long, text string, _l int, _p int, _s int")
    r = merkle.add_fingerprint(df).first()
    assert (r["_l"], r["_p"], r["_s"]) == (5, 6, 7) and r["fingerprint"] == merkle.add_fingerprint(df.select("text")).first()["fingerprint"]


def test_mtree_counts_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.0])]
    got = sorted(map(tuple, mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()))
    assert got == [(0, 1, 1, 2048), (0, 2, 1, 2048), (0, 3, 2, 1024), (20, 1, 1, 2048), (20, 2, 1, 2048), (20, 3, 0, 0)]
