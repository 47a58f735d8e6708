"""Toxicity votes, vector codes and ranked search against brute force and SQL."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import lexical, toxicity, vector_codes
from lectern.llm.registry import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
rng = random.Random(5)
INSULTS = ["vilox", "grumpf", "skarn"]
PLAIN = [a + b + c for a in ("ka", "lo", "mi", "tu") for b in ("ne", "ri", "so") for c in ("", "p", "t")]


def prose(n, bad=0.0):
    return " ".join(rng.choice(INSULTS) if rng.random() < bad else rng.choice(PLAIN) for _ in range(n))


def save(frame, folder, name):
    frame.to_parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def toxic(spark):
    rows = [(i, prose(rng.randint(8, 60), 0.2 if i % 4 == 0 else 0.0), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 0.5, 9) for i, t, _ in rows], "doc_id bigint, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id bigint, toxic int, quality int")
    return rows, docs, labels, toxicity.train(docs, labels)


def test_votes_are_right_on_held_out_documents(spark, toxic):
    rows, docs, labels, votes = toxic
    got = {r.doc_id: r for r in toxicity.with_score(docs, votes, "doc_id").collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 150
    assert all(got[i].predicted == y for i, y in held)
    brier = sum((got[i].score - y) ** 2 for i, y in held) / len(held)
    assert brier < 0.01
    learned = {e[0] for e in toxicity.vectors(toxicity.labelled(docs, labels.where(toxicity.third(F.col("doc_id")) != 1)), {})}
    assert not learned & {i for i, _ in held}
    assert all(set(got[i].evidence) <= learned and len(got[i].evidence) == toxicity.NEAREST for i, _ in held)


def test_nearest_equal_brute_force(toxic):
    rows, _, _, votes = toxic
    index, terms = votes.index, votes.terms
    examples = [(i, y, *terms.vector(t)) for i, t, y in rows]
    small = toxicity.BlockMaxIndex(terms.size, [e[0] for e in examples], [e[1] for e in examples], [e[2:] for e in examples], block=8)

    def dense(place, weight):
        out = np.zeros(terms.size)
        out[place] = weight
        return out

    all_of = np.array([dense(*e[2:]) for e in examples])
    queries = [terms.vector(prose(rng.randint(1, 40), rng.choice([0, 0.1, 0.6]))) for _ in range(150)]
    small.opened = 0
    for place, weight in queries:
        cosine = (all_of @ dense(place, weight)).round(12)
        least = np.sort(cosine)[-toxicity.NEAREST]
        want = {e[0]: c for e, c in zip(examples, cosine) if c >= least - 1e-11}
        got, at = small.nearest(place, weight)
        assert list(got) == sorted(got, reverse=True)
        assert set(small.ids[at].tolist()) <= set(want)
        assert {i for i, c in want.items() if c > least + 1e-11} <= set(small.ids[at].tolist())
        assert np.allclose([want[i] for i in small.ids[at].tolist()], got, atol=1e-11)
    assert small.opened / len(queries) < 0.8 * len(small.starts)
    assert index is not None


def test_chi_square_and_frequency_choose_terms(spark):
    examples = spark.createDataFrame([(i, int(i < 20), f"common w{i} " + ("bad" if i < 20 else "good")) for i in range(60)], "doc_id bigint, toxic int, text string")
    known = toxicity.vocabulary(examples, 60, 20)
    assert {"bad", "good"} <= set(known) and "common" not in known and "w3" not in known
    assert known["bad"][1] == pytest.approx(1 + math.log(61 / 21))
    assert len(toxicity.vocabulary(examples, 60, 20, max_terms=2)) == 2


def test_toxicity_edges(spark, toxic):
    _, docs, labels, votes = toxic
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, " \n"), (None, "vilox grumpf vilox"), (5, "vilox lonep " * 200_000)], "doc_id bigint, text string")
    got = toxicity.with_score(odd, votes, "doc_id").collect()
    assert [r.score for r in got[:4]] == [votes.prior] * 4 and not got[0].evidence
    assert got[4].doc_id is None and got[4].predicted == 1 and got[5].predicted == 1
    none = toxicity.train(docs, labels.where("false"))
    assert {r.score for r in toxicity.with_score(odd, none, "doc_id").collect()} == {0.0}
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.with_score(odd, one).collect()} == {0}
    assert toxicity.with_score(docs.limit(0), votes, "doc_id").count() == 0
    with pytest.raises(ValueError):
        toxicity.with_score(docs, votes, "score")


def test_a_repeated_id_is_one_example(spark):
    docs = spark.createDataFrame([(0, f"text {i}") for i in range(3000)] + [(i, prose(9)) for i in range(2, 60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (0, None), (None, 1), *((i, 1) for i in range(2, 60))], "doc_id bigint, toxic int")
    rows = toxicity.labelled(docs, labels).collect()
    assert len(rows) == 59
    assert [(r.toxic, r.text) for r in rows if r.doc_id == 0] == [(0, "text 0")]
    assert toxicity.labelled(docs, labels, 7).count() == 7


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, np.array(v)) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    x = [[math.floor(1024 * float(c)) for c in v] for _, _, v in kept]
    w = len(x[0]) // parts
    split = [[v[p * w : (p + 1) * w] for v in x] for p in range(parts)]
    books = [[list(v) for v in s[:entries]] for s in split]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(v, books[p])[1] for v in split[p]]
            for k in range(len(books[p])):
                mine = [v for v, o in zip(split[p], own) if o == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[nearest(split[p][r], books[p]) for p in range(parts)] for r in range(len(x))]
    errors = Counter()
    for (_, label, _), f in zip(kept, found):
        errors[label] += sum(d for d, _ in f)
    return sorted((-1 if i is None else i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[label]) for (i, label, _), f in zip(kept, found)), books


VECTOR = "vec_id bigint, embedding array<float>, label int, code string, error int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], VECTOR)


def odd_vectors(n, seed=3, width=16):
    r = np.random.default_rng(seed)
    rows = [(int(i), r.normal(0, 0.4, width).astype(np.float32).tolist(), [0, 0, 0, 1, None][i % 5]) for i in range(n)]
    rows += [(n + 1, None, 0), (n + 2, [None] + [0.5] * (width - 1), 1), (n + 3, [float("nan")] * width, 1), (n + 4, [float("inf")] + [0.0] * (width - 1), 1)]
    rows += [rows[3], rows[3], (None, [0.25] * width, 2), (7, [-0.0001] * width, None), (7, [0.0] * width, None)]
    return rows


@pytest.mark.parametrize("n", [1, 60, 700])
def test_codes_equal_brute_force(spark, tmp_path, n):
    rows = odd_vectors(max(n, 8))
    frame = vectors_of(spark, rows).repartition(5)
    want, books = brute_codes(rows)
    codebooks = vector_codes.train(frame)
    assert [b.tolist() for b in codebooks] == books
    coded = vector_codes.with_label_error(vector_codes.encode(frame, codebooks, "vec_id", "label"))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()) == want


def test_label_errors_beyond_broadcast(spark, monkeypatch):
    frame = spark.createDataFrame([(i, i % 3 or None, i) for i in range(50)], "vec_id bigint, label int, error bigint")
    plain = sorted(map(str, vector_codes.with_label_error(frame).collect()))
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 1)
    assert sorted(map(str, vector_codes.with_label_error(frame).collect())) == plain


@pytest.mark.parametrize("width", [1, 2, 3, 16, 40])
@pytest.mark.parametrize("size", [1, 3, 200])
def test_bounds_lose_no_entry(width, size):
    r = np.random.default_rng(width * size)
    for scale, kind in ((3, "few values"), (900, "plain"), (2**24, "large")):
        c, x = r.integers(-scale, scale, (size, width)), r.integers(-scale, scale, (700, width))
        x[:20], c[size // 2] = c[r.integers(0, size, 20)], c[0]
        d = ((x[:, None, :].astype(object) - c[None]) ** 2).sum(2)
        book = vector_codes.Codebook(c)
        entry, distance = book.nearest(x)
        assert (entry == d.argmin(1)).all() and (distance == d.min(1)).all(), kind


def test_bounds_rule_out_most_entries():
    r = np.random.default_rng(0)
    centres = r.normal(0, 600, (256, 16))
    x = (centres[r.integers(0, 256, 4000)] + r.normal(0, 60, (4000, 16))).astype(np.int64)
    book = vector_codes.Codebook(centres.astype(np.int64))
    book.nearest(x)
    assert book.tested < 0.1 * 256 * len(x)


def test_vectors_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        vector_codes.integers(pa.array([[1.0, 2.0], [1.0]]))
    with pytest.raises(ValueError):
        vector_codes.integers(pa.array([[1e30, 2.0]]))
    with pytest.raises(ValueError):
        vector_codes.parts_of(np.zeros((2, 6), np.int64), 4)


def test_empty_and_decoded_vectors(spark):
    empty = vectors_of(spark, [(1, None, 0)])
    assert vector_codes.train(empty) == []
    assert vector_codes.encode(empty, [], "vec_id", "label").count() == 0
    rows = odd_vectors(20)
    frame = vectors_of(spark, rows)
    books = vector_codes.train(frame, entries=4)
    back = vector_codes.decode(vector_codes.encode(frame, books, "vec_id", "embedding"), books)
    for r in back.collect():
        x = np.floor(1024 * np.array(r.embedding))
        assert ((x - np.array(r.integers)) ** 2).sum() == r.error


def brute_search(docs, items, k=10, once=True):
    bags = [(i, Counter(lexical.terms_of(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, b in bags:
            m = b.total() and 100 - 90 + 90 * b.total() * n_docs // n_terms
            score = sum((1 if once else q) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, q in Counter(lexical.terms_of(text)).items() if b[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


DOCS = [(i, prose(rng.randint(1, 40))) for i in range(90)] + [(200 + i, "kane kane lori") for i in range(14)] + [(3, "Kane LORI_x éa-ß"), (3, "Kane LORI_x éa-ß"), (None, "kane lori mis"), (None, "kane"), (300, None), (301, ""), (302, "-- !"), (303, "tusot " * 50_000)]
ITEMS = [(1, "kane lori"), (2, "Kane kane KANE tusot"), (2, "kane"), (3, None), (4, "..."), (5, "nowhere"), (None, "mine"), (6, " ".join(PLAIN)), (7, "éa ß lori_x")]


def frames(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in DOCS], "doc_id bigint, text string, score int, rank int").repartition(7)
    return docs, spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id bigint, text string, doc_id int")


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("block", [10_000, 2])
def test_search_equals_brute_force(spark, monkeypatch, once, block):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    docs, items = frames(spark)
    got = lexical.search(docs, items, once=once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(DOCS, ITEMS, once=once)


def test_search_in_small_batches(spark):
    docs, items = frames(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert sorted(map(tuple, lexical.search(docs, items, 3).collect()), key=str) == brute_search(DOCS, ITEMS, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_search_of_empty_tables(spark):
    docs, items = frames(spark)
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.limit(0), items).count() == 0


def test_impacts_do_not_overflow():
    n = np.array([10**9, 10])
    got = lexical.impacts(n, np.array([0, 1]), np.array([0, 0]), np.array([5, 5]), np.array([7]), 10**10, 10**12)
    want = [7 * (10**9 * 5 // (5000 + 8 * (10 + 90 * int(x) * 10**10 // 10**12))) for x in n]
    assert got.tolist() == want


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_lexical_search"])
def test_sql_of_odd_tables(spark, tmp_path, name):
    save(pd.DataFrame(DOCS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}), tmp_path, "documents")
    save(pd.DataFrame(ITEMS, columns=["item_id", "text"]).astype({"item_id": "Int64"}), tmp_path, "benchmark")
    vectors_of(spark, odd_vectors(300)).select("vec_id", "embedding", "label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(str, want.select(*columns).fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def test_repeated_ids_reach_the_driver_once(spark, monkeypatch):
    from lectern.llm import gru, language_model, quality_rules

    docs = spark.createDataFrame([(0, prose(30 + i % 7)) for i in range(2000)] + [(i, prose(20)) for i in range(1, 40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    seen = []
    plain = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: (seen.append(out := plain(self)), out)[1])
    ids, x, quality = quality_rules.labelled_statistics(docs, labels, with_words=True)
    assert ids.tolist() == list(range(40)) and len(x) == len(quality) == 40 and 30 <= x[0][-1] <= 36
    assert [t.num_rows for t in seen] == [40]
    seen.clear()
    monkeypatch.setattr(language_model, "START_STEPS", 1)
    vocabulary = language_model.Vocabulary
    numbers = docs.select("doc_id", F.expr("array(0, 1)").alias("ids"))
    monkeypatch.setattr(language_model, "Trainer", lambda w, layout, rate: type("T", (), {"w": w, "steps": 0, "epoch": lambda self, d, e, n: setattr(self, "steps", 1)})())
    monkeypatch.setattr(language_model, "start_weights", lambda layout: {})
    fake = type("V", (), {"layout": None, "__getitem__": lambda self, k: 0})()
    language_model._start(numbers, fake)
    assert [t.num_rows for t in seen] == [40] and vocabulary and gru
