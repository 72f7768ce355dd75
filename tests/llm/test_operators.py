"""Each operator on hand-made rows against a plain reckoning, with nulls, empty and long texts, ties, repeats and clashing names."""

import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codeloom.llm import html_extraction, language_id, line_dedup, packing, token_counts, token_files
from codeloom.llm.components import connected_components
from codeloom.llm.decontamination import decontaminate, proximity_matches
from codeloom.llm.embedding_join import near_duplicate_vectors
from codeloom.llm.jaccard_join import jaccard_components
from codeloom.llm.line_dedup import dedup_lines
from codeloom.llm.sharding import rendezvous_shard, shard_records
from codeloom.llm.tokens import ChunkTokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "It's 12,5 o'clock <|endoftext|> x y\tz", "Ünïcödé ΣΑΣ 日本語 😀", "word " * 9000, "a" * 5000, "*** ---", "x\x00y"]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randint(0, 400)) for _ in range(n))


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(500, 500), (7, None)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == groups(real, {x for e in real for x in e})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_learns_and_leaves_letterless_texts_unknown(spark):
    rng = random.Random(1)
    kinds = {"aa": ["tion", "the", "ing"], "bb": ["eau", "que", "oux"], "cc": ["sch", "ung", "ein"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(30)), k) for i in range(90) for k in [rng.choice(list(kinds))]]
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(5, None, "aa"), (None, "tion the ing", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_id.fit_language_model(df)
    got = language_id.identify_language(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        if r.lang is not None and r.text:
            assert r.lang_pred == r.lang
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert r.lang_pred == "und" and r.score == 0
    none = language_id.fit_language_model(df.limit(0))
    assert {r.lang_pred for r in language_id.identify_language(df, none).collect()} == {"und"}
    assert language_id.identify_language(df.limit(0), model).count() == 0


def test_language_scores_equal_the_plain_kernel():
    rng = random.Random(31)
    kinds = {"aa": ["tion", "the", "ing"], "bb": ["eau", "que", "oux"], "cc": ["sch", "ung", "ein"]}
    labels = [rng.choice(list(kinds)) for _ in range(60)]
    texts = [" ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(rng.randint(1, 30))) for k in labels]
    seen = np.zeros(1 << language_id.BITS, bool)
    bits = [language_id.ngram_bits(t, seen) for t in texts]
    model = language_id.KernelModel.fit(bits, labels, landmarks=24)
    # The same by whole kernel matrices over sets.
    sets = [set(b.tolist()) for b in bits]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = [i for name in sorted(kinds) for i in [j for j, x in enumerate(labels) if x == name][:8]]
    k_all = np.array([[kernel(a, sets[i]) for i in marks] for a in sets])
    values, vectors = np.linalg.eigh(k_all[marks])
    keep = values > 1e-8 * values.max()
    x = np.hstack([k_all @ vectors[:, keep] / np.sqrt(values[keep]), np.ones((60, 1))])
    weight = np.array([60 / (3 * labels.count(lab)) for lab in labels])
    penalty = 1e-3 * 60 * np.diag([1.0] * keep.sum() + [0.0])
    best = []
    for name in sorted(kinds):
        y = np.array([1.0 if lab == name else -1.0 for lab in labels])
        best.append(x @ np.linalg.solve(x.T @ (x * weight[:, None]) + penalty, x.T @ (y * weight)))
    best = np.array(best).T
    names, scores = model.predict(bits)
    assert names == [sorted(kinds)[i] for i in best.argmax(axis=1)]
    assert np.allclose(scores, np.clip((best.max(axis=1) + 1) / 2, 0, 1), atol=1e-4)


def test_language_model_learns_from_every_row(spark):
    rng = random.Random(32)
    kinds = {"aa": ["tion", "the", "ing"], "bb": ["eau", "que", "oux"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(20)), k) for i in range(1500) for k in [rng.choice(list(kinds))]]
    rows += [(2000 + i, "жук " * 5 + "".join(rng.choices("бвгд", k=4)), "bb") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = np.zeros(1 << language_id.BITS, bool)
    bits = [language_id.ngram_bits(t, seen) for _, t, _ in rows]
    labels = [x for _, _, x in rows]
    model = language_id.fit_language_model(df, landmarks=8, counted=True)
    # The same landmarks, with all rows' equations and counts in one place.
    counts = {x: labels.count(x) for x in kinds}
    marks = language_id.landmark_rows(df.selectExpr("cast(doc_id as string) as key", "lang"), "lang", "key", counts, 4).collect()
    marks = sorted((r.key, r.lang) for r in marks)
    by_key = {str(i): b for (i, _, _), b in zip(rows, bits, strict=True)}
    basis = language_id.Basis(language_id.chosen([by_key[k] for k, _ in marks], [x for _, x in marks], sorted(kinds), 8))
    want = language_id.KernelModel.solved(basis, basis.equations(bits, labels, sorted(kinds), language_id.weights(counts)), sorted(kinds), len(rows))
    assert np.allclose(model.rows, want.rows, atol=1e-5) and np.allclose(model.bias, want.bias)
    often = np.zeros(1 << language_id.BITS, bool)
    for name in kinds:
        set_by = np.bincount(np.concatenate([b for b, x in zip(bits, labels, strict=True) if x == name]), minlength=1 << language_id.BITS)
        often |= set_by * 4 >= counts[name]
    assert (model.known == often).all()


def test_packing_is_gapless_and_near_the_bound(spark):
    rng = random.Random(2)
    texts = ODD + [prose(rng, rng.choice([3, 40, 300, 900, 1500, 3000])) for _ in range(60)] + ["same text"] * 20
    rows = packing.pack_documents(docs(spark, texts), WORDS, 1, 4096).collect()
    lib = ChunkTokenizer(WORDS).tokenizer
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [(r.start, r.length, r.ids_crc32) for r in pieces] == [(k, len(p := ids[k : k + 4096]), zlib.crc32(np.array(p, "<u4"))) for k in range(0, len(ids), 4096)]
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1 + 1.1 * sum(r.length for r in rows) / 4096
    assert packing.pack_documents(docs(spark, []), WORDS).count() == 0


def test_packing_plan_pairs_large_items_best():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.choice([6, 30, 99])
        sizes = [rng.randint(capacity // 3 + 1, capacity) for _ in range(rng.randint(1, 14))]
        counts = {s: sizes.count(s) for s in sizes}
        plan = packing.plan_packing(counts, capacity)
        bins = int((plan[:, 3] + (plan[:, 2] - 1) // plan[:, 5]).max()) + 1
        left, alone = sorted(sizes), 0
        while left:  # two pointers: optimal for items over a third
            big = left.pop()
            fits = [i for i, s in enumerate(left) if s + big <= capacity]
            if fits:
                left.pop(fits[-1])
            alone += 1
        assert bins == alone


def test_packing_fills_gaps_as_plain_best_fit_does():
    rng = random.Random(41)
    for _ in range(200):
        capacity = rng.choice([12, 40, 97])
        sizes = [rng.randint(1, rng.choice([capacity // 3, capacity // 6 + 1, capacity])) for _ in range(rng.randint(1, 60))]
        large = sorted(x for x in sizes if 3 * x > capacity)
        rooms = []
        while large:  # the longest with the longest partner that fits
            big = large.pop()
            fits = [i for i, x in enumerate(large) if x + big <= capacity]
            rooms.append(capacity - big - (large.pop(fits[-1]) if fits else 0))
        for x in sorted((x for x in sizes if 3 * x <= capacity), reverse=True):
            open_ = [r for r in rooms if r >= x]
            if open_:
                rooms.remove(min(open_))
                rooms.append(min(open_) - x)
            else:
                rooms.append(capacity - x)
        plan = packing.plan_packing({x: sizes.count(x) for x in sizes}, capacity)
        assert int((plan[:, 3] + (plan[:, 2] - 1) // plan[:, 5]).max()) + 1 == len(rooms)


def brute_vectors(vectors, cosine):
    ok = {i: np.array(v, float) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    pairs = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= cosine]
    comp = groups(pairs, [i for i, _ in vectors])
    return {i: (sum(i in p for p in pairs), comp[i], comp[i] == i) for i, _ in vectors}


def test_embedding_join_against_brute_force(spark, monkeypatch):
    from codeloom.llm import embedding_join

    monkeypatch.setattr(embedding_join, "BLOCK_BYTES", 64 * 12 * 8)
    monkeypatch.setattr(embedding_join, "LEAF", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 12))
    rows = [list(map(float, v)) for v in base] + [list(map(float, base[rng.integers(0, 40)] + rng.normal(size=12) * rng.choice([0.02, 0.12, 0.25]))) for _ in range(250)]
    rows += [rows[3]] * 30 + [[2 * x for x in rows[3]], None, [0.0] * 12, [float("nan")] + [1.0] * 11, [None] + [1.0] * 11, [float("inf")] * 12, [], [1.0, 2.0], [2.0, 4.1], [1e-200] * 12, [1e200] * 12]
    vectors = list(enumerate(rows))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).collect()}
    with np.errstate(all="ignore"):
        want = brute_vectors(vectors[:-2], 0.95)
    assert {k: v for k, v in got.items() if k in want} == want
    assert got[len(rows) - 2][:2] == (1, len(rows) - 2)  # the two equal directions link, however small or large
    assert near_duplicate_vectors(df.limit(0)).count() == 0
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors[:400]]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(spark.createDataFrame(single, "vec_id long, embedding array<float>")).collect()}
    assert got == brute_vectors(single, 0.95)


def test_spanning_links_keep_parts_together():
    from codeloom.llm.embedding_join import _roots, _spanning

    rng = np.random.default_rng(0)
    for _ in range(200):
        hit = rng.random((12, 9)) < rng.choice([0.02, 0.1, 0.3, 0.9])
        every = np.nonzero(hit)
        some = _spanning(hit)
        assert (_roots(21, every[0], every[1] + 12) == _roots(21, some[0], some[1] + 12)).all()


def test_token_files_round_trip(spark):
    texts = ODD + [prose(random.Random(9), 50)] * 3
    df = docs(spark, texts).orderBy(F.rand(1)).withColumn("part", F.lit("clash"))
    path = token_files.write_token_files(df, WORDS, 2)
    stored = token_files.read_token_files(spark, path)
    lib = ChunkTokenizer(WORDS).tokenizer
    want, at = {}, 0
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4")))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digest(stored).collect()} == want
    assert token_files.token_digest(token_files.read_token_files(spark, token_files.write_token_files(df.limit(0), WORDS, 2))).count() == 0


def test_token_files_answer_counts_and_ranges_from_few_pages(spark):
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(10)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no key"), (None, "no key"), (5, texts[5]), (5, "another")]
    path = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 2, page_bytes=4 << 10)
    lib = ChunkTokenizer(WORDS).tokenizer
    ids = lambda t: [*lib.encode(t, add_special_tokens=False).ids, 2]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in token_files.read_counts(spark, path).collect()) == sorted((-1 if k is None else k, len(ids(t))) for k, t in rows)
    assert "tokens:array" not in token_files.read_counts(spark, path)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert {r.doc_id: r.tokens for r in token_files.read_documents(spark, path, 40, 60).collect()} == {i: ids(texts[i]) for i in range(40, 61)}
    plan = token_files.read_documents(spark, path, 40, 60)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,40)" in plan
    for f in glob.glob(path.removeprefix("file://") + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            by_name = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "RLE_DICTIONARY" in by_name["tokens.list.element"].encodings
            assert by_name["n_tokens"].encodings == by_name["start_in_part"].encodings == ("DELTA_BINARY_PACKED", "RLE") or "DELTA_BINARY_PACKED" in by_name["n_tokens"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in by_name.values())
    digest = token_files.token_digest(token_files.read_token_files(spark, path)).collect()
    total = sum(len(ids(t)) for _, t in rows)
    spans = sorted((r.start, r.n_tokens) for r in digest)
    assert [s for s, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) == total


def test_token_counts_at_every_prefix(spark):
    counter = token_counts.PrefixCounter(PIECES)
    texts = [*ODD, " x", "x ", "a  b   c", "\n a", "▁a ▁▁b", "don't 12345", prose(random.Random(6), 80)]
    for t in texts:
        t = (t or "")[:300]
        assert counter.prefix_counts(t).tolist() == [len(counter.lib.encode(t[:i])) for i in range(len(t) + 1)]
        assert counter.longest_prefix(t, 3) == max(i for i in range(len(t) + 1) if len(counter.lib.encode(t[:i])) <= 3)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts).withColumn("n_tokens", F.lit("clash")), PIECES, 4096).collect()}
    for i, t in enumerate(texts):
        n = len(counter.lib.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)


def test_token_counts_of_blanks_repeats_and_no_rows(spark):
    import time

    counter = token_counts.PrefixCounter(PIECES)
    counter.count(" " * 1000)
    for t in (" " * 1_000_000, "x" + " " * 300_001 + "\0" * 2000 + "y"):
        began = time.process_time()
        n = counter.count(t)
        assert time.process_time() - began < 2 and n == len(counter.lib.encode(t))
    df = docs(spark, ["a  b", None, ""]).unionByName(spark.createDataFrame([(0, "a  b"), (None, "x y z"), (None, None)], "doc_id long, text string")).withColumn("fit_chars", F.lit("clash"))
    got = token_counts.count_tokens(df, PIECES, 2).collect()
    size = lambda t: len(counter.lib.encode(t or ""))
    rows = [(0, "a  b"), (0, "a  b"), (1, None), (2, ""), (None, "x y z"), (None, None)]
    want = [(i, len((t or "").encode()), size(t), size(t) > 2, max(k for k in range(len(t or "") + 1) if size((t or "")[:k]) <= 2)) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts.count_tokens(df.limit(0), PIECES, 2).count() == 0
    prefixes = {r.doc_id: r.prefix_tokens for r in token_counts.prefix_table(docs(spark, ["a  b\nword", None]), PIECES).collect()}
    assert prefixes == {0: [size("a  b\nword"[:k]) for k in range(10)], 1: [0]}


def test_token_counts_over_small_blocks_and_tables(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(17)
    bits = ["a", "the", "b ", " ", "  ", "\n", "▁", "\0", "é", "日本", "😀", "Word", "12345", "ing", " " * 17]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(150))]
    counter, cut = token_counts.PrefixCounter(PIECES, max_words=40, max_fits=50), token_counts.blocks
    monkeypatch.setattr(token_counts, "blocks", lambda data, space: cut(data, space, 7))
    for budget in (1, 4):
        n, fit = counter.count_column(pa.array(texts, pa.string()), budget)
        for t, a, b in zip(texts, n, fit, strict=True):
            sizes = [len(counter.lib.encode((t or "")[:k])) for k in range(len(t or "") + 1)]
            assert a == sizes[-1] and b == max(k for k, x in enumerate(sizes) if x <= budget)


def test_chunk_tokenizer_equals_the_library_with_a_tiny_cache():
    small = ChunkTokenizer(WORDS, max_units=5, max_ids=40)
    rng = random.Random(8)
    for _ in range(5):
        texts = [t or "" for t in ODD] + [prose(rng, 30) for _ in range(5)] + ["Wörd!!! wörd,x İ ſ. 'S it'll. é. ñ***"]
        ids, stops = small.encode_batch(texts)
        at = 0
        for t, stop in zip(texts, stops, strict=True):
            assert ids[at:stop].tolist() == small.tokenizer.encode(t, add_special_tokens=False).ids
            at = stop


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    df = spark.range(3000).select(F.col("id").alias("key")).unionByName(spark.createDataFrame([(None,), (5,), (5,)], "key long"))
    out = shard_records(df, "key", [1.0, 1.0, 2.0]).withColumn("grown", rendezvous_shard(F.col("key"), [1.0, 1.0, 2.0, 1.0])).collect()
    by_shard = defaultdict(list)
    for r in out:
        assert r.grown in (r.shard, 3)
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert 0.42 < len(by_shard[2]) / len(out) < 0.58
    assert shard_records(df.limit(0), "key", [1.0]).count() == 0
    with pytest.raises(ValueError):
        rendezvous_shard(F.col("key"), [1.0, 0.0])


def test_sharding_equals_a_plain_reckoning(spark):
    import math
    import struct

    import xxhash

    def draw(key, shard, weight):
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(str(key).encode(), 42))
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight

    weights = [1.0, 2.0, 0.5, 1.0]
    df = spark.createDataFrame([(i, "a" * (i % 3)) for i in range(400)], "key long, shard string").withColumn("slot", F.lit("clash"))
    for r in shard_records(df, "key", weights).collect():
        assert r.shard == min(range(4), key=lambda s: draw(r.key, s, weights[s]))


def test_html_keeps_the_article_and_drops_what_stands_around(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>"</script></head><body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this site.</p><button>OK</button></div><article><h1>A title &amp; more</h1><p>The  first
    paragraph of the text,&nbsp;with <b>bold</b> words and some length to it.<p>A second one follows, long enough to be a part of the text.<ul><li>A point</li></ul></article>
    <section id="comments"><div class="comment"><p>Nice article, thank you very much!</p></div></section><footer>&copy; Someone</footer>"""
    model = html_extraction.main_text_model()
    want = "A title & more\n\nThe first paragraph of the text, with bold words and some length to it.\n\nA second one follows, long enough to be a part of the text.\n\nA point"
    assert html_extraction.main_text(page, model) == want
    rows = [(0, page), (1, None), (2, ""), (3, "<p>"), (4, "<div>" * 3000 + "deep"), (5, page), (6, "a < b <!-- x <p"), (7, "\0")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extraction.extract_main_text(df).collect()}
    assert got[0] == got[5] == want and got[1] == got[2] == got[3] == got[7] == ""
    assert html_extraction.extract_main_text(df.limit(0)).count() == 0


def test_html_model_on_pages_it_has_not_seen():
    model, right, n = html_extraction.main_text_model(), 0, 80
    for i in range(n):
        page = html_extraction._Pages(77_000_000 + i).page()
        tree = html_extraction.Tree(page)
        want = "\n\n".join(t.replace(html_extraction._KEEP, "") for t in tree.blocks() if html_extraction._KEEP in t)
        right += html_extraction.main_text(page.replace(html_extraction._KEEP, ""), model) == want
    assert right >= 0.85 * n


def test_decoding_never_contradicts_itself():
    rng = np.random.default_rng(1)
    parent = [-1] + [int(rng.integers(0, i)) for i in range(1, 200)]
    keep = html_extraction.decode(parent, rng.normal(size=200))
    assert all(keep[parent[i]] for i in range(1, 200) if keep[i])


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return _WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.choice([2, 10, 14, 30]))) for i in range(12)] + [(12, None), (13, ""), (14, "*** !!"), (15, "Only Three words"), (16, "the " * 15)]
    items += [(17, items[0][1])]
    texts = [*ODD, "we say ONLY three-words here", "only three", "the " * 40] + [prose(rng, 20) + " " + items[k % 12][1] + ". " + prose(rng, 5) + " " + items[(k + 3) % 12][1].upper() for k in range(24)] + [prose(rng, 200)] * 2
    df = docs(spark, texts).unionByName(docs(spark, [texts[-3]], len(texts) - 3)).withColumn("n_hit", F.lit("clash"))
    got = decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        w, hit, found = _words(r.text), set(), set()
        for item, text in items:
            iw = _words(text)
            n = min(10, len(iw))
            for s in range(len(iw) - n + 1) if n else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == iw[s : s + n]:
                        hit.update(range(k, k + n))
                        found.add(str(item))
        assert (r.n_words, r.n_hit, r["items"] or []) == (len(w), len(hit), sorted(found))
    assert decontaminate(df, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0
    assert decontaminate(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_proximity_search(spark):
    got = proximity_matches(docs(spark, ["a b x x c", "c a", None, "a x x x x c"]), ["A", "c"], 4).collect()
    assert {(r.doc_id, r.start, r.stop) for r in got} == {(1, 0, 1)}


def test_proximity_reads_the_same_words_as_the_rest(spark):
    rng = random.Random(12)
    texts = ["Ärzte sind hier", "ärzte HIER", "hier - Ärzte", None, ""] + [" ".join(rng.choice(["Ärzte", "hier", "HIER", "x", "été"]) for _ in range(rng.randint(1, 20))) for _ in range(40)]
    wanted, within = ["Ärzte", "Hier"], 4
    want = set()
    for i, t in enumerate(texts):
        w = _words(t)
        last = {}
        for k, x in enumerate(w):
            if x in ("Ärzte", "hier"):
                last[x] = k
                if len(last) == 2 and k - min(last.values()) < within:
                    want.add((i, min(last.values()), k))
    got = proximity_matches(docs(spark, texts).withColumn("term", F.lit("clash")), wanted, within).collect()
    assert {(r.doc_id, r.start, r.stop) for r in got} == want and len(got) == len(want)
    assert proximity_matches(docs(spark, []), wanted, within).count() == 0


def _shingles(text, n=5):
    w = (text or "").encode().lower().split()
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_jaccard_join_against_brute_force(spark, monkeypatch):
    from codeloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 5)
    monkeypatch.setattr(jaccard_join, "QUERY_TOKENS", 600)
    rng = random.Random(12)
    seeds = [prose(rng, n).split() for n in (8, 20, 60, 120, 120)]
    passage = prose(rng, 60)
    texts = [*ODD, "A b C", "a B c"]
    for _ in range(160):
        w = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 3)}"
        texts.append(" ".join(w))
    texts += [prose(rng, 15) + " " + passage for _ in range(40)]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(None, texts[-1]), (3, "again " * 7)], "doc_id long, text string")).withColumn("component_id", F.lit("clash"))
    sets = {i: _shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    got = jaccard_components(df.where("doc_id != 3")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets if i != 3}
    every = jaccard_components(df).collect()
    assert len(every) == len(texts) + 2 and [r.component_id for r in every if r.doc_id is None] == [None]
    assert jaccard_components(df.limit(0)).count() == 0


def test_jaccard_bound_holds_for_every_size_of_a_block(spark):
    from codeloom.llm import jaccard_join

    def shared(n, m, percent):
        up = lambda a, b: -(-a // b)
        return max(1, up(percent * (n + m), 100 + percent) - max(up(percent * n, 100), up(percent * m, 100)) + 1)

    ranges = [(n, a, b) for n in [*range(2, 90), 158, 333] for a in range(max(1, int(0.8 * n)), int(1.25 * n) + 1) for b in range(a, int(1.05 * a) + 1)]
    df = spark.createDataFrame(ranges, "n long, a long, b long")
    for percent in (80, 40):
        got = df.withColumn("x", jaccard_join._least_shared_in(F.col("n"), F.col("a"), F.col("b"), percent)).collect()
        want = [min(shared(r.n, m, percent) for m in range(r.a, r.b + 1)) for r in got]
        assert all(w - 1 <= r.x <= w for r, w in zip(got, want, strict=True))
        if percent == 80:
            assert [r.x for r in got] == want and {(r.n, r.a, r.b): r.x for r in got}[58, 58, 60] == 5


def test_line_dedup_keeps_the_first_of_equal_and_like_lines(spark):
    rng = random.Random(13)
    long = prose(rng, 60)
    typo = long.replace("a", "e", 1)
    texts = ["Unique one\n" + long, None, "", long.upper() + "\nunique ONE \n***\n\nown line here", typo + "\n***", "other words entirely stand here\n" + long, "日本語の文章です。ここに長い文があります"]
    df = docs(spark, texts).withColumn("n_removed", F.lit("clash"))
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert got[0].text == texts[0] and got[0].n_removed == 0
    assert got[1].text is None and got[1].n_lines == 0 and got[2].text == "" and got[2].n_lines == 1
    assert got[3].text == "***\n\nown line here" and got[3].n_removed == 2
    assert got[4].text == "***"
    assert got[5].text == "other words entirely stand here"
    assert got[6].text == texts[6]
    assert dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_recall_against_brute_force(spark):
    rng = random.Random(14)
    seeds = [prose(rng, rng.randint(10, 50)).split() for _ in range(25)]
    texts = []
    for _ in range(120):
        lines = []
        for _ in range(3):
            w = list(rng.choice(seeds))
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = f"zz{rng.randint(0, 999)}"
            lines.append(" ".join(w))
        texts.append("\n".join(lines))
    places = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    sets = {line: {line[i : i + 8] for i in range(len(line) - 7)} or {line} for _, _, line in places}  # from every character
    names = sorted(sets)
    comp = groups([(a, b) for a in names for b in names if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], names)
    seen, want = set(), 0
    for _, _, line in places:
        want += comp[line] in seen
        seen.add(comp[line])
    got = sum(r.n_removed for r in dedup_lines(docs(spark, texts)).collect())
    assert 0.97 * want <= got <= want


def test_line_dedup_compares_lines_whose_leader_is_like_neither(spark, monkeypatch):
    # All lines meet in one bucket, whose leader is like none of them.
    monkeypatch.setattr(line_dedup, "signatures", lambda lines: lines.select("id", *[F.lit(0).alias(f"m{k}") for k in range(24)]).distinct())
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 3, raising=False)
    rng = random.Random(21)
    lines = [prose(rng, 30) for _ in range(12)]
    df = docs(spark, lines + [t + " tail" for t in lines])
    lost = {r.doc_id for r in dedup_lines(df).where("n_removed > 0").collect()}
    assert lost == set(range(12, 24))


def test_line_dedup_compares_all_that_stand_apart_in_a_large_bucket(spark, monkeypatch):
    # All lines meet in one bucket, larger than what is compared at once, and agree in all minima: no further minima cut it.
    monkeypatch.setattr(line_dedup, "signatures", lambda lines: lines.select("id", *[F.lit(0).alias(f"m{k}") for k in range(24)]).distinct())
    monkeypatch.setattr(line_dedup, "DEALT", 16)
    rng = random.Random(24)
    lines = [prose(rng, 30) for _ in range(40)]
    df = docs(spark, lines + [t + " tail" for t in lines])
    assert {r.doc_id for r in dedup_lines(df).where("n_removed > 0").collect()} == set(range(40, 80))


def test_line_dedup_reads_words_to_their_end(spark):
    rng = random.Random(22)
    lines = ["Order 2024000123", "Order 2024000199", "x" * 7, "x" * 6]
    for _ in range(60):
        w = prose(rng, rng.randint(3, 25))
        k = rng.randrange(len(w))
        lines += [w, w[:k] + "#" * rng.randint(1, 4) + w[k + rng.randint(0, 3) :], " ".join(x + "abcdefghij"[: rng.randint(4, 9)] for x in w.split())]
    sets = {t: {t[i : i + 8] for i in range(len(t) - 7)} or {t} for t in lines}
    names = sorted(sets)
    comp = groups([(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], names)
    seen, want = set(), set()
    for i, t in enumerate(lines):
        if comp[t] in seen:
            want.add(i)
        seen.add(comp[t])
    got = {r.doc_id for r in dedup_lines(docs(spark, lines)).where("n_removed > 0").collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and not got & {0, 1, 2, 3}


def test_line_dedup_tells_rows_of_one_key_apart(spark):
    rows = [(1, "common line that is here\nown words of the first text"), (6, "common line that is here"), (6, "a thing that nobody else has said"), (None, "common line that is here\nmore words"), (None, "quite another line of words"), (None, None), (6, "common line that is here")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.text, r.n_removed) for r in got if r.text is not None) == sorted([
        ("1", "own words of the first text", 1), ("6", "", 1), ("6", "", 1), ("6", "a thing that nobody else has said", 0),
        ("None", "common line that is here\nmore words", 0), ("None", "quite another line of words", 0),
    ])
    many = "\n".join(["a line that is repeated all over"] * 3000 + ["the last one"])
    got = dedup_lines(docs(spark, [many])).first()
    assert got.text == "a line that is repeated all over\nthe last one" and got.n_removed == 2999


def test_line_dedup_keeps_lines_that_differ_late_in_a_word(spark):
    lines = ["order20240101123456", "order20240199999999", "internationalisation department", "internationalization department", "x" * 400, "x" * 500, "y" * 90 + "z" * 90]
    assert dedup_lines(docs(spark, lines)).where("n_removed > 0 and doc_id != 5").count() == 0  # 400 and 500 x are one shingle


def test_line_dedup_finds_pairs_on_both_sides_of_the_sampled_length(spark):
    rng = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz "
    lines, want = [], 0
    for n in (100, 120, 128, 140, 155, 158, 160, 165, 180, 200, 400, 900):
        for _ in range(6):
            t = "".join(rng.choices(letters, k=n - 1)) + "e"
            lines += [t, t[: n // 2] + "".join(rng.choices(letters, k=max(1, n // 60))).strip() + t[n // 2 :]]
            want += 1
    got = {r.doc_id for r in dedup_lines(docs(spark, lines)).where("n_removed > 0").collect()}
    assert got <= set(range(1, len(lines), 2)) and len(got) >= 0.97 * want


def test_line_dedup_tries_few_pairs_of_a_large_mixed_bucket_and_all_like_ones(spark):
    rng = random.Random(12)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(110)]
    lines = []
    for i in range(300):  # copies of a line with two stretches of their own, far from each other; every tenth has a like one
        line = list(base)
        for at in (rng.randrange(0, 45), rng.randrange(55, 95)):
            line[at : at + 12] = rng.choices("0123456789", k=12)
        lines.append("".join(line))
        if i % 10 == 0:
            lines.append("".join(line[:-4]) + "wxyz")
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    like = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    none = spark.createDataFrame([], "a long, b long")
    got = {(r.a, r.b) for r in line_dedup.rest_pairs(df.select("id", df.id.alias("component")), df, none).collect()}
    assert len(like) >= 30 and like <= got
    assert len(got) < 3 * len(lines)  # of 54,000 pairs


def test_line_dedup_verifies_few_pairs_and_all_like_ones(spark, monkeypatch):
    rng = random.Random(31)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)]
    lines = ["x" * 90, "x" * 40, "short", "ab" * 60]
    for changed in (4, 8, 12, 16, 20, 30, 40, 60, 80):  # from nearly the same to half the same, repeats among them
        for _ in range(6):
            line = list(base)
            at = rng.randrange(300 - changed)
            line[at : at + changed] = rng.choices("0123456789", k=changed)
            lines.append("".join(line) + "x" * rng.choice((0, 30)))
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    every = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines))]
    like = {(i, j) for i, j in every if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    tried, real = [], line_dedup.alike
    monkeypatch.setattr(line_dedup, "alike", lambda pairs, *rest: tried.append(pairs.count()) or real(pairs, *rest))
    got = {(r.a, r.b) for r in line_dedup.verified(spark.createDataFrame(every, "a long, b long"), df).collect()}
    assert 100 < len(like) < len(every) / 2 and got == like
    assert tried[0] < len(every) / 3


def test_line_dedup_leaves_no_table_but_small_ones(spark, monkeypatch):
    left, cut = {}, line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df, name: left.setdefault((out := cut(df, name)).inputFiles()[0].rsplit("/", 1)[0], (name, out))[1])
    rng = random.Random(32)
    dedup_lines(docs(spark, [prose(rng, 30) for _ in range(20)] * 2)).collect()
    there = {name for folder, (name, _) in left.items() if os.path.exists(folder.removeprefix("file://").removeprefix("file:"))}
    assert not there & {"lines", "signatures", "meeting", "inside", "labelled", "met-lines", "sketches", "dealt"}


def test_line_dedup_verifies_pairs_of_large_buckets_where_they_meet(spark):
    rng = random.Random(33)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)]
    lines = []
    for _ in range(120):  # copies of similarities around 0.8
        line = list(base)
        for at in rng.sample(range(0, 190, 10), 2):
            line[at : at + 3] = rng.choices("0123456789", k=3)
        lines.append("".join(line))
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    like = sorted((i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    apart = df.select(F.explode(F.array(F.lit(5), F.lit(7))).alias("bucket"), "id", df.id.alias("component"))
    got = line_dedup.rest_pairs(apart, df, spark.createDataFrame([], "a long, b long"))
    assert sorted((r.a, r.b) for r in got.collect()) == like and 0 < len(like) < 120 * 119 / 2


def test_line_dedup_lets_lines_of_common_words_rarely_meet(spark):
    rng = random.Random(34)
    words = ["tion", "the", "and", "ing", "ere", "of", "in", "re", "ble", "that"]
    lines = [" ".join("".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(25)) for _ in range(3000)]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(lines)], "id long, line string, n int")
    assert line_dedup.meetings(line_dedup.signatures(df)).select("id").distinct().count() < len(lines) / 5
