"""Chat views, mixing, the language model, the Jaccard join, archives and the pipeline."""

import base64
import gzip
import hashlib
import io
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import chat, gru, jaccard, language_model, mixing, warc
from lectern.llm.common import WORD, fold_of, lowered

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, predicted int, contaminated string, _key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 9, "c", "k") for i, t, s in rows], DOCS)


EDGE = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (3, "one two", None), (4, "x " * 30_000, "b"), (None, "no id at all here now", "b"), (5, "éa ßb", "á"), (6, " \n ", "c")]


def brute_views(turns):
    out = {}
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t, r or "unknown", x or ""))
    for c, lines in by.items():
        for me in {r for _, r, _ in lines} - {"system"}:
            parts = defaultdict(list)
            for t, r, x in sorted(lines, key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2])):
                parts[-1 if t is None else t // chat.TURNS].append((r, x))
            for p, own in parts.items():
                text, masks = "", []
                for r, x in own:
                    text += "<|turn|>" + ("assistant" if r == me else "system" if r == "system" else f"user name={r}") + "\n"
                    if r == me:
                        masks.append(f"{len(text)}:{len(text) + len(x)}")
                    text += x + "<|end|>\n"
                out[c, me, p] = (len(own), text, ",".join(masks))
    return out


def test_views_equal_brute_force(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "ann", "hé\U0001f642"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 300, "ann", "late"), (1, None, "cy", "first"), (None, 0, "ann", "x"), (2, 0, None, "y"), (3, 0, "system", "only")]
    frame = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id bigint, turn bigint, role string, text string, part string")
    got = {(r.conv_id, r.perspective, r.part): (r.n_turns, r.text, r.masks) for r in chat.perspectives(frame).collect()}
    assert got == brute_views(turns)
    assert chat.perspectives(frame.limit(0)).count() == 0


def brute_seats(votes, n):
    got = [0] * len(votes)
    for _ in range(n):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


def test_seats_go_by_highest_quotients():
    rng = random.Random(1)
    for _ in range(400):
        votes = [rng.choice([0, 1, 2, 5, rng.random() * 100, rng.randint(1, 1000)]) for _ in range(rng.randint(1, 9))]
        n = rng.randint(0, 200)
        if sum(votes):
            assert mixing.sainte_lague(np.array(votes), n).tolist() == brute_seats(votes, n)


def test_targets_fill_up_by_weight():
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30, 120, 60]
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(0, 50) for _ in range(rng.randint(1, 8))]
        weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
        left, open_, got = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
        while open_:  # share, cap those above their limit, and share what they leave again
            w = sum(weights[i] for i in open_)
            full = {i for i in open_ if left * weights[i] / w > 3 * sizes[i]}
            if not full:
                for i in open_:
                    got[i] = left * weights[i] / w
                break
            for i in full:
                got[i] = Fraction(3 * sizes[i])
            left -= sum(got[i] for i in full)
            open_ -= full
        assert mixing.targets(sizes, weights) == got


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 400), rng.choice(["a", "a", "b", "c", None])) for i in range(900)]
    docs = docs_of(spark, [*rows, *EDGE])
    one = mixing.mix(docs).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    assert len(one) == len(rows) + len(EDGE)
    assert Counter((r.doc_id, r.size) for r in one) == Counter((i, len((t or "").split())) for i, t, _ in [*rows, *EDGE])
    for s in {r.source for r in one}:
        own = [r for r in one if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.BLOCK_WORDS * (1 + len({r.shard for r in own}))
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_quotas_of_very_many_sources(spark, monkeypatch):
    """Window functions give what the driver gives, and a table of more than 100,000 sources is mixed whole."""
    rng = random.Random(12)
    for n in (1, 3, 40, 700):
        rows = [(None if i == 5 else f"s{i:05d}", 1, rng.choice([0, 1, 7, 300, 90_000, 5_000_000])) for i in range(n)]
        sources = spark.createDataFrame(rows, "source string, rows bigint, size bigint")
        few, many = ({r.source: (r.source_size, round(r.target, 4), r.quota) for r in mixing.source_quotas(sources, few, mixing.WEIGHTS, 3, 16).collect()} for few in (True, False))
        assert few == many
    docs = spark.range(100_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"))
    got = mixing.mix(docs).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("target").alias("target"), F.sum("taken").alias("taken"), F.count_if(F.expr("taken > 3 * size")).alias("over")).first()
    assert got.n == 100_500 and got.over == 0 and abs(got.target - got.size) < 1 and got.taken > 0


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(0)
    layout = gru.Layout(np.sort(rng.integers(2, 1000, 9000))[::-1].astype(float), 300.0)
    w = {k: v + rng.normal(0, 0.05, v.shape).astype(np.float32) for k, v in gru.start_weights(layout).items()}
    docs = [np.append(rng.integers(-1, 9000, n), 5) for n in (0, 3, gru.WINDOW, 2 * gru.WINDOW + 7)]
    for d, got in zip(docs, gru.score(w, layout, docs)):
        h, last, total = np.zeros((1, gru.HIDDEN), np.float32), 5, 0.0
        for t in d:
            h = gru._step(w, w["emb"][layout.input[last]][None] @ w["w"] + w["b"], h)[0]
            total += gru.output_log10(w, layout, h, np.array([t]))[0]
            last = t
        assert abs(total - got) < 1e-3 * len(d)


def test_output_is_a_distribution():
    layout = gru.Layout(np.arange(9000, 0, -1).astype(float), 50.0)
    w = gru.start_weights(layout)
    h = np.random.default_rng(1).normal(0, 0.5, (1, gru.HIDDEN)).astype(np.float32)
    ids = np.arange(-1, 9000)
    p = 10 ** gru.output_log10(w, layout, np.repeat(h, len(ids), 0), ids)
    assert abs(p.sum() - 1) < 1e-3


def test_gradient_is_the_numeric_one():
    rng = np.random.default_rng(2)
    layout = gru.Layout(np.arange(300, 0, -1).astype(float), 20.0)
    w = {k: v.astype(np.float64) for k, v in gru.start_weights(layout).items()}
    w["cw"] += rng.normal(0, 0.3, w["cw"].shape)
    w["ow"] += rng.normal(0, 0.3, w["ow"].shape)
    want = rng.integers(-1, 300, (4, 6))
    inputs, fresh = layout.input[rng.integers(0, 300, (4, 6))], np.zeros((4, 6), bool)
    fresh[:, 0] = fresh[1, 3] = True

    def run(weights):
        t = gru.Trainer({k: v.astype(np.float32) for k, v in weights.items()}, layout, 0.0)
        seen = {}
        t._update = lambda grad: seen.update(grad)
        return t.window(inputs, want, fresh, np.zeros((4, gru.HIDDEN), np.float32))[1], seen

    _, grad = run(w)
    for k, place in (("u", (3, 20)), ("w", (2, 40)), ("cw", (0, 4)), ("ow", (5, 1)), ("b", (7,)), ("emb", (int(inputs[0, 1]), 2))):
        eps = 1e-2
        up, down = {n: v.copy() for n, v in w.items()}, {n: v.copy() for n, v in w.items()}
        up[k][place] += eps
        down[k][place] -= eps
        numeric = (run(up)[0] - run(down)[0]) / (2 * eps)
        assert abs(numeric - grad[k][place]) < 2e-3


def test_language_model_scores(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["The cat", "sat on", "a mat", "ßig dog", "ran"]) for _ in range(rng.randint(1, 40)))
    rows = [(i, text(), "s") for i in range(120)] + EDGE + [(7, "unseen words only", "s")]
    out = language_model.model_scores(docs_of(spark, rows).select("doc_id", "text")).collect()
    c = Counter()
    for i, t, _ in rows:
        if i is None or fold_of(i) != 1:
            c.update(language_model.tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in rows:
        w = language_model.tokens(t)
        want[i, i is not None and fold_of(i) == 1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    held = [r for r in out if r.held_out and r.n_known > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    empty = language_model.model_scores(docs_of(spark, EDGE[:1]).select("doc_id", "text").limit(0))
    assert empty.count() == 0


def test_words_of_arrow_are_those_of_the_pattern():
    texts = [None, "", " ", "\t a\x0bB  c\u2003d \x1c e\x85", "ÀÉ Ab", "x", " lead", "trail \n", "\U0001f642 Z\x00y", *(t for _, t, _ in EDGE)]
    for own in (texts, texts[:1], [], texts[3:5]):
        words, n = language_model.words_of(pa.array(own, pa.string()))
        want = [re.findall(WORD, lowered(t)) if t else [] for t in own]
        assert words.to_pylist() == [w for x in want for w in x] and n.tolist() == [len(x) for x in want]


def test_numbers_of_words(spark):
    counts = {"the": 9, language_model.END: 8, "cat": 3}
    value = (list(counts), np.array(list(counts.values())), 30, 9)
    v = language_model.Vocabulary(*value)
    rows = [*[(i, t, "s") for i, t in enumerate(["The cat", "", "a cat a\tthe B", None])], *EDGE]
    got = language_model.numbered(docs_of(spark, rows), spark.sparkContext.broadcast(value)).collect()
    want = Counter()
    for i, t, _ in rows:
        words, ids = v.ids(t)
        want[i, tuple(ids.tolist()), tuple(w for w in words if w not in counts)] += 1
    assert Counter((r.doc_id, tuple(r.ids), tuple(r.rare)) for r in got) == want


def test_a_very_long_text_is_trained_and_scored_in_bounded_memory():
    layout = gru.Layout(np.arange(3000, 0, -1).astype(float), 20.0)
    rng = np.random.default_rng(4)
    long = np.append(rng.integers(-1, 3000, 1_000_000), 5).astype(np.int32)
    tracemalloc.start()
    t = gru.Trainer(gru.start_weights(layout), layout, 0.005)
    t.epoch([long, long[:10]], 5)
    total = gru.score(t.w, layout, [long[-200_000:], long[:10]])
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
    assert np.isfinite(total).all() and t.steps < 200


def test_model_trains_on_every_document(spark, monkeypatch):
    """Null and repeated ids too, and beyond the documents that start the model."""
    monkeypatch.setattr(language_model, "START_DOCS", 1)
    ids = [None, None, 8, 8, *range(20, 36)]
    rows = [(i, "one two three four " * (k + 1), "s") for k, i in enumerate(ids)]
    docs = docs_of(spark, rows).select("doc_id", "text").coalesce(1)
    c = Counter(w for _, t, _ in rows for w in language_model.tokens(t))
    words = sorted(c, key=lambda w: (-c[w], w))
    value = (words, np.array([c[w] for w in words]), sum(c.values()), len(c))
    vocabulary = language_model.Vocabulary(*value)
    got = language_model.train(docs, spark.sparkContext.broadcast(value), vocabulary)
    want = gru.Trainer(language_model._start(docs, vocabulary), vocabulary.layout, language_model._RATES[1])
    want.epoch([vocabulary.ids(t)[1] for _, t, _ in rows], vocabulary[language_model.END])
    assert all(np.allclose(got[k], want.w[k], atol=1e-5) for k in got)


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(WORD, lowered(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 3000))
    passage = " ".join(word() for _ in range(30))
    out = []
    for size in [1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 150, 400]:
        for _ in range(3):
            base = [word() for _ in range(size)]
            out.append(" ".join(base))
            for _ in range(6):  # copies with a few words changed, added or left out
                x = list(base)
                for _ in range(rng.randint(0, max(1, size // 40) + 1)):
                    k = rng.randrange(len(x) + 1)
                    x[k : k + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
                out.append(" ".join(x) if rng.random() < 0.8 else " ".join(x).upper())
            out.append(passage + " " + " ".join(base))
    return out


@pytest.mark.parametrize("small", [32, 2])
def test_components_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", small)
    texts = near_corpus(small) + ["", None, " \n", "Same text", "same TEXT"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    sizes, roots = brute_components(texts)
    first = {}
    for i, r in enumerate(roots):
        first.setdefault(r, i)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs_of(spark, rows)).collect()}
    assert got == {i: (sizes[i], first[roots[i]]) for i in range(len(texts))}
    kept = sorted(r.doc_id for r in jaccard.keep_one(docs_of(spark, rows)).collect())
    assert kept == sorted(set(first.values()))


def test_signatures_lose_no_link():
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 90, 333]:
        for _ in range(6):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            gone = rng.integers(0, max(1, n // 5) + 1)
            new = rng.integers(0, 2**63, rng.integers(0, max(1, n // 5) + 1)).astype(np.uint64)
            b = np.union1d(a[gone:], new)
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size
                bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in jaccard.sketch(a) ^ jaccard.sketch(b))
                assert bits <= len(a) + len(b) - 2 * both


def test_join_edges(spark):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs_of(spark, EDGE)).collect()}
    assert rows == {(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4), (None, 2, None), (5, 1, 5), (6, 0, 6)}
    kept = jaccard.keep_one(docs_of(spark, EDGE))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6]
    assert jaccard.similarity_classes(docs_of(spark, [])).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300)]
    got = {r.node: r.comp for r in jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


PAGES = [(1, "http://a.org/x", "<p>é</p>"), (2, "http://b.org/\r\nx", None), (3, None, ""), (4, "https://www.a.org:8443/x?q=1", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (5, "http://a.org/x", "<p>é</p>"), (9, "bad:// [", "<p>é</p>"), (9, "http://a.org/x", "<p>é</p>"), (None, "http://c.org", "")]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id bigint, url string, html string, payload string")
    index = warc.archive_and_index(pages, f"file://{tmp_path}/w").collect()
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in PAGES:
        b, top = (h or "").encode(), last[h or ""]
        response = i == top
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else top] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index) == want
    assert [r.url_key for r in index] == sorted(r.url_key for r in index)
    assert warc.archive_and_index(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_captures_are_read_from_their_offsets(spark, tmp_path, monkeypatch):
    """Small archives and ranges; one payload in a third of the pages; each record alone from its place in the archive."""
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 7)
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, f"http://h{i % 5}.org/{i}", "hot" if i % 3 == 0 else f"<p>{i} é</p>" * (i % 4)) for i in range(90)]
    index = warc.archive_and_index(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"file://{tmp_path}/w").collect()
    html, last = {i: h.encode() for i, _, h in rows}, {h: i for i, _, h in rows}
    assert sorted(r.page_id for r in index) == list(range(90)) and len({r.archive for r in index}) >= 90 // 7
    assert [(r.url_key, r.captured_at) for r in index] == sorted((r.url_key, r.captured_at) for r in index)
    for r in index:
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            record = zlib.decompressobj(31).decompress(f.read())
        i = r.page_id
        assert f"<urn:page:{i}>".encode() in record
        assert r.refers_to == (None if last[html[i].decode()] == i else last[html[i].decode()])
        assert record.endswith((b"" if r.refers_to is not None else html[i]) + b"\r\n\r\n")
    whole = [warc.members(memoryview(open(p, "rb").read())) for p in {r.archive.removeprefix("file:") for r in index}]
    assert sum(len(list(warc.parse(io.BytesIO(gzip.decompress(open(p.removeprefix("file:"), "rb").read()))))) for p in {r.archive for r in index}) == sum(len(list(m)) for m in whole) == 90


def test_loser_tree_merges_runs():
    rng = random.Random(3)
    for k in range(8):
        runs = [sorted(({"v": rng.randint(0, 9)} for _ in range(rng.randint(0, 6))), key=lambda r: r["v"]) for _ in range(k)]
        got = [r["v"] for r in warc.LoserTree(runs, key=lambda r: (r["v"],))]
        assert got == sorted(r["v"] for x in runs for r in x)


def test_damaged_archives_are_found():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 24\r\n\r\nContent-Length: 1\r\n\r\nxxx\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(record)))


def test_url_keys():
    assert warc.url_key("https://www.Example.org:443/a?b#c") == "org,example)/a?b"
    assert warc.url_key(None) == ""


def pipeline_tables(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ten", "sur"]) for _ in range(rng.randint(1, 4)))
    good = lambda: " ".join(word() for _ in range(rng.randint(60, 140)))
    bench = [(i, " ".join("q" + word() for _ in range(14))) for i in range(3)]
    docs = [(i, good(), f"s{i % 3}") for i in range(160)]
    docs += [(i, " ".join(w + "$$$" for w in good().split()), "s1") for i in range(160, 200)]
    docs += [(200, docs[3][1], "s0"), (201, docs[3][1] + " more", "s0"), (202, f"{good()} {bench[1][1]} {good()}", "s1"), (203, good() + ' password = "abcdefgh12345" ' + good(), "s2")]
    frame = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 160), 0) for i in range(0, 200, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return frame


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs, folder, seen = pipeline_tables(spark, str(tmp_path)), str(tmp_path), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        docs.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["quality classifier"]) == {*range(160), *range(200, 204)}
    assert set(seen["near duplicates"]) == {*range(160), 202, 203}
    assert set(seen["benchmark decontamination"]) == {*range(160), 203}
    redacted = seen["secret scans"][203]
    assert "[secret]" in redacted.text and "abcdefgh12345" not in redacted.text and redacted.n_chars == len(redacted.text)
    assert set(seen["mixing to target weights"]) == {*range(160), 203}
    whole = corpus_pipeline.run(spark, folder)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, seen["mixing to target weights"].values()))


def test_stages_bear_clashing_columns_and_empty_tables(spark, tmp_path):
    pipeline_tables(spark, str(tmp_path))
    docs = docs_of(spark, [*EDGE, (50, "plain words that say nothing much " * 12, "a")])
    for docs in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                assert {(r.predicted, r.contaminated, r._key) for r in map(lambda r: r, out.collect())} <= {(9, "c", "k")}
            else:
                out.collect()
