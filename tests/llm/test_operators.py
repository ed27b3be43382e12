"""Every operator against a plain version, on a small table and on odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import time
from collections import defaultdict

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from presswork.llm import mixing, packing, pii, quality, registry, simhash, substrings, tokenfiles, tokens, toxicity, vptree, warc
from presswork.operators.components import connected_components
from presswork.shared import shared_path
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(params=["documents", "odd"])
def docs(request):
    return request.getfixturevalue(request.param)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_quality_measures(docs):
    got = quality.ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes("base-1")).alias("f")).collect()
    assert by_id(got) == by_id((i, *brute.quality(t)) for i, t in pairs(docs))


def test_quality_policies_and_ablations(docs):
    rows = quality.ledger(docs).cache()
    bits = [r.rule_bits for r in rows.collect()]
    assert quality.filter_quality(docs).count() == sum(b & quality.mask("strict-1") == 0 for b in bits)
    for r in quality.ablations(rows, "strict-1").collect():
        bit = 1 << quality.RULES[r.rule][0]
        assert (r.n_failed, r.n_failed_alone) == (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits))
        assert r.n_kept_without == sum(b & ~bit == 0 for b in bits)


def test_simhash(docs):
    rows = [(i, t) for i, t in pairs(docs) if i is not None]
    got = {r.doc_id: (f"{r.simhash & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got == brute.near_groups(dict(rows).items())


def test_null_ids_link_others(spark):
    """Three fingerprints in a chain, the middle one of a row without an id."""
    prints = spark.createDataFrame([(1, 1), (None, 15), (3, 127), (None, 0xFF << 40), (None, 0x1FF << 40)], "doc_id long, simhash long")
    assert {(r.doc_id, r.component_id) for r in simhash.near_groups(prints).collect()} == {(1, 1), (None, 1), (3, 1), (None, None)}


def test_close_pairs_are_all_found_in_any_block():
    random = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 700):
        base = random.integers(0, 1 << 63, 5, dtype=np.uint64)
        flips = (np.uint64(1) << random.integers(0, 64, (n, 4), dtype=np.uint64)) * (random.random((n, 4)) < 0.6).astype(np.uint64)
        prints = base[random.integers(0, 5, n)] ^ np.bitwise_xor.reduce(flips, axis=1)
        for radius in (0, 1, 3, 6):
            want = {(i, j) for i in range(n) for j in range(i + 1, n) if int(prints[i] ^ prints[j]).bit_count() <= radius}
            assert {(i, int(j)) for i, near in simhash.close_pairs(prints, radius) for j in near} == want


def test_link_edges_split_hot_buckets(spark):
    random = np.random.default_rng(5)
    prints = sorted({int(x) for x in (np.uint64(7) << np.uint64(40)) ^ (np.uint64(1) << random.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << random.integers(0, 64, 400, dtype=np.uint64))})
    frame = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, print long")
    edges = simhash.link_edges(frame, most=16).collect()
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert (prints[a] ^ prints[b]).bit_count() <= 64
        root[find(a)] = find(b)
    want = list(range(len(prints)))

    def seek(x):
        while want[x] != x:
            x = want[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                want[seek(i)] = seek(j)
    assert len({find(i) for i in root}) == len({seek(i) for i in want})


def test_bands_grow_with_the_prints(spark):
    assert [simhash.bands_for(n) for n in (0, 1 << 20, (1 << 20) + 1, 1 << 29, 1 << 30, 10**13)] == [4, 4, 5, 5, 6, 8]
    random = np.random.default_rng(6)
    base = random.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(base[random.integers(0, 40, 500)] ^ (np.uint64(1) << random.integers(0, 64, 500, dtype=np.uint64)))
    frame = spark.createDataFrame([(i, int(p)) for i, p in enumerate(prints.view(np.int64))], "node long, print long")
    found = [sorted(map(tuple, connected_components(simhash.link_edges(frame, bands, 64)).collect())) for bands in (4, 5, 6)]
    assert found[0] and found[0] == found[1] == found[2]


def test_keep_one_of_an_id_by_its_text(spark):
    rows = spark.createDataFrame([(1, "one text of words"), (1, "quite another text of words")], "doc_id long, text string")
    kept = {tuple(simhash.keep_one(rows.repartition(n)).collect()) for n in (1, 2, 3)}
    assert len(kept) == 1 and len(kept.pop()) == 1


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 9} <= set(ids) and 8 not in ids and None in ids and 2 not in ids


def test_private_base(docs):
    got = pii.detect(docs, None).select("doc_id", *pii.COUNTS, "base_sha256").collect()
    assert by_id(got) == by_id((i, *brute.private(t)) for i, t in pairs(docs))


def test_private_model_and_redaction(spark):
    texts = [f"call phone +1 (20{i % 10}) 555-{1000 + i} or write user{i}@mail{i % 5}.example.com password=ab{i}cd{i * 7}ef now about {i * 31} things" for i in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(frame)
    assert model is not None
    rows = pii.detect(frame, model).collect()
    assert all(r.n_phone == 1 and r.n_email == 1 for r in rows)
    assert sum("secret:" in r.spans for r in rows) > 290
    assert all("@" not in r.text and "+1" not in r.text and "things" in r.text for r in pii.redacted(frame, model).collect())
    assert pii.fit(frame.limit(0)) is None


def test_long_secrets_are_redacted_whole(spark):
    texts = [f"note {i} has token=ab{i}cd{i * 7}ef in it and price: thing{i % 9} too" for i in range(300)]
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    value = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(9))
    text = f"note has token={value} in it"
    assert pii.redact(text, pii.find_spans([text], model)[0][1]) == "note has [SECRET] in it"


def test_parts_of_number_groups_are_proposed():
    card, phone = "4111 1111 1111 1111", "(201) 555-1000"
    for text in (f"2023 {card} 05", f"2023-{card.replace(' ', '-')}-05", " ".join([card] * 5), f"at 12 {phone} 7 {phone} 9/1 {phone} 3"):
        want = card.replace(" ", "-") if "-4111" in text else card if card in text else phone
        found = {(s, e) for s, e, _, _ in pii.proposals(text)}
        at = [i for i in range(len(text)) if text.startswith(want, i)]
        assert {(i, i + len(want)) for i in at} <= found
    assert any(k == 1 and text[s:e] == "10.1.2.3" for text in ("12 10.1.2.3 44",) for s, e, k, _ in pii.proposals(text))


def test_cards_within_number_groups_are_redacted(spark):
    def card(i):
        digits = f"4{i * 7919 % 10**14:014d}"
        return next(digits + c for c in "0123456789" if pii.luhn(digits + c))

    def parted(digits):
        return " ".join(digits[k : k + 4] for k in range(0, 16, 4))

    texts = [f"paid {i} by {parted(card(i))} or not {parted(f'{i * 104729 % 10**16:016d}')} on time" for i in range(1, 600)]
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    text = f"paid in 2023 {parted(card(777))} 05 on time"
    assert not pii.base_spans(text)
    assert pii.redact(text, pii.find_spans([text], model)[0][1]) == "paid in 2023 [CARD] 05 on time"


def test_other_forms_of_addresses_are_learnt(spark):
    forms = (lambda i: f"joe{i} [at] mail{i % 5} [dot] com", lambda i: f"2001:db8:0:{i % 7}:1:2:3:{i}", lambda i: f"2001:db8::{i}:7", lambda i: f"at 10:{10 + i % 40}:{10 + i % 30} it is {10 + i % 90}:2b:3c:{i % 7}d:5e:{10 + i % 70}")
    texts = [f"note {i} says {forms[i % 4](i)} and user{i}@mail{i % 5}.example.com. Then more" for i in range(800)]
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for text, want in (
        ("so ann [at] mail [dot] org. Then more", "so [EMAIL]. Then more"),
        ("so 2001:db8:0:9:8:7:6:5 and", "so [IP] and"),
        ("so 2001:db8::77:3 and", "so [IP] and"),
        ("so at 10:11:12 it is 14:2b:3c:4d:5e:60 and", "so at 10:11:12 it is 14:2b:3c:4d:5e:60 and"),
    ):
        assert pii.redact(text, pii.find_spans([text], model)[0][1]) == want


def test_trees_give_the_probabilities_of_the_library(spark):
    random = np.random.default_rng(4)
    x = random.normal(size=(600, 4)).round(2)
    rows = [(Vectors.dense(v), float(v[0] + v[1] * v[2] > 0.3)) for v in x.tolist()]
    frame = spark.createDataFrame(rows, ["x", "label"])
    trees = GBTClassifier(featuresCol="x", maxIter=6, maxDepth=pii.DEPTH, seed=1).fit(frame)
    model = pii.Model([pii._arrays(t) for t in trees.trees], list(trees.treeWeights), {})
    want = [r.probability[1] for r in trees.transform(frame).collect()]
    assert np.allclose(model.probability(x), want)


def test_planted_secrets_are_found_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = pii.fit(docs)
    planted = found = 0
    for r in pii.detect(docs, model).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s.startswith("secret:")]
        for m in re.finditer(r'(?i)token = "[0-9a-f]{40}"', r.text or ""):
            planted += 1
            found += any(int(s) <= m.start() and int(e) >= m.end() for _, s, e in spans)
    assert planted >= 10 and found == planted


def test_altered_forms_are_learnt(spark):
    def phone(i):
        return f"+1 ({200 + i % 700}) 555-{1000 + i * 7 % 9000}"

    texts = [f"note {i} call {phone(i)} or write {('user%d' % i, 'ann.lee')[i % 2]}@{('mail%d.example.com' % (i % 5), 'post.org')[i // 2 % 2]} by 2019-0{1 + i % 9}-1{i % 10} on {i * 37 % 9000} 12 {i % 100}" for i in range(900)]
    text, spans = pii.altered(texts[5], pii.base_spans(texts[5]))
    assert [text[s:e] for s, _, e in spans] == ["(205) 555-1035", "ann.lee (at) mail0 (dot) example (dot) com"]
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for text, want in (("so call (212) 555-0100 now", "so call [PHONE] now"), ("so joe.b [at] mail [dot] com on 2019-04-12", "so [EMAIL] on 2019-04-12")):
        assert pii.redact(text, pii.find_spans([text], model)[0][1]) == want


def test_redact_joins_overlaps():
    assert pii.redact("abcdef", [(1, 0, 3), (2, 2, 5)]) == "a[EMAIL]f"


def test_tokens_match_the_library(docs):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        got = tokenfiles.tokenized(docs, name).where("n_tokens > 0").select("doc_id", "ids").collect()
        want = [(i, np.array(brute.tokens(t, name), "<u2").tobytes()) for i, t in pairs(docs)]
        assert by_id((r.doc_id, bytes(r.ids)) for r in got) == by_id(want)


def test_tokens_of_random_texts():
    random = np.random.default_rng(17)
    signs = [*"aAbzZ .,;:!?'\n\t-09_", "'s", "'LL", "  ", "\u0130", "\u0130.", "i\u0307", "I\u0307", "\u0307", "\u212a", "\u037e", "\u03a3", "\u00df", "\u1e9e", "\u00e9", "e\u0301", "\u00a0", "\u0085", "\u2028", "\u65e5", "\U0001f600", "\x00", "<|endoftext|>", "\ufb01", "\u01c5", "\u0149"]
    texts = ["".join(signs[i] for i in random.integers(0, len(signs), random.integers(0, 14))) for _ in range(6000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        flat, lengths = tokens.with_end(pa.array(texts, pa.string()), name)
        for text, ids in zip(texts, np.split(flat, np.cumsum(lengths)[:-1])):
            assert ids.tolist() == brute.tokens(text, name), repr(text)


def test_token_files(docs):
    got = [(r.doc_id, r.start, r.n_tokens, brute.crc(np.frombuffer(r.ids, "<u4"))) for r in tokenfiles.round_trip(docs).collect()]
    want, start = [], 0
    ids = sorted(((i, brute.tokens(t, "word_bpe_49k.json")) for i, t in pairs(docs)), key=lambda x: (x[0] is not None, x[0] or 0))
    for i, t in ids:
        want.append((i, start, len(t), brute.crc(t)))
        start += len(t)
    assert by_id(got) == by_id(want)


def test_token_files_split_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "PART_IDS", 64)
    rows = [(None if i % 3 else tokenfiles.NO_ID if i % 2 else i, f"word {i} and more") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.start, r.doc_id, bytes(r.ids)) for r in tokenfiles.round_trip(frame).collect())
    assert by_id((i, ids) for _, i, ids in got) == by_id((i, np.array(brute.tokens(t, "word_bpe_49k.json"), "<u4").tobytes()) for i, t in rows)
    start = 0
    for at, _, ids in got:
        assert at == start
        start += len(ids) // 4
    order = [tokenfiles.NO_ID if i is None else i for _, i, _ in got]
    assert order == sorted(order)
    ranges = tokenfiles.Ranges([5, 5, 5, 9])
    assert ranges.parts == 6 and ranges.part(np.array([4, 5, 5, 6, 10]), np.array([0, 0, (1 << 32) - 1, 7, 7])).tolist() == [0, 1, 3, 4, 5]


def test_token_file_damage_is_told():
    control, data = tokenfiles.encode_ranks(np.array([1, 300, 70_000, 20_000_000, 5]), np.array([3, 2]))
    block = tokenfiles.encode_block([None, tokenfiles.NO_ID], [3, 2], b"".join(control.to_pylist()), b"".join(data.to_pylist()), 11) + b"\n"
    keys, lengths, ranks, base = next(tokenfiles.decode_blocks(block))
    assert (keys.tolist(), lengths.tolist(), ranks.tolist(), base) == ([None, tokenfiles.NO_ID], [3, 2], [1, 300, 70_000, 20_000_000, 5], 11)
    with pytest.raises(ValueError):
        list(tokenfiles.decode_blocks(block[:-3] + b"x" + block[-2:]))


def test_packing(docs):
    rows = packing.pack_documents(docs, keep_ids=True).cache()
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows.collect()]
    want = []
    for i, t in pairs(docs):
        ids = brute.tokens(t, "byte_bpe_50k.json")
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, brute.crc(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert by_id(got) == by_id(want)
    bins = defaultdict(list)
    for r in rows.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        placed.sort()
        assert placed[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:])) and sum(placed[-1]) <= 1024
    total = sum(len(brute.tokens(t, "byte_bpe_50k.json")) for _, t in pairs(docs))
    parts = len({r.sequence_id // packing.APART for r in rows.collect()})
    assert len(bins) <= 1.02 * total / 1024 + parts
    assert sum(len(r.ids) // 4 for r in packing.sequences(rows).collect()) == total


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


def test_open_bins_match_a_plain_best_fit():
    random = np.random.default_rng(9)
    for most in (1, 3, 40, 1000):
        bins, used, closed, made = packing.OpenBins(100, most), [], 0, 0
        for size in random.integers(1, 101, 3000).tolist():
            fitting = [u for u in used if u + size <= 100]
            at = max(fitting, default=0)
            if fitting:
                used.remove(at)
            else:
                if len(used) == most:
                    used.remove(max(used))
                    closed += 1
                made += 1
            if at + size < 100:
                used.append(at + size)
            assert bins.place(size)[1] == at
        assert bins.made == made and bins.count == len(used) and (closed > 0) == (most < 1000)


def test_packing_keeps_the_order_of_arrival(spark):
    frame = spark.createDataFrame([(i % 7, "word " * (i * 37 % 900)) for i in range(300)], "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(frame, keep_ids=True).collect()
    assert [r.row for r in rows if r.piece == 0] == sorted({r.row for r in rows}) and len({r.row for r in rows}) == 300
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_repeats(docs):
    rows = [(i, t) for i, t in pairs(docs) if i is not None]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect() if r.doc_id is not None}
    assert got == brute.repeats(dict(rows).items())


def test_factors_have_their_sources(spark):
    shared, other = [f"s{i}" for i in range(40)], [f"o{i}" for i in range(30)]
    texts = {1: ["a"] * 3 + shared, 2: other + ["b"], 3: [f"x{i}" for i in range(9)] + shared[5:] + other[:20] + ["y"], 4: shared[:12] + other[:12]}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    found = {r.doc_id: substrings.joined([f.asDict() for f in r.factors]) for r in substrings.factors(frame).collect()}
    assert found == {3: [(9, 35, 1, 8), (44, 20, 2, 0)]}


def test_windows_of_one_block_are_told_apart_by_all_their_bytes(spark):
    random = np.random.default_rng(11)
    names = [f"w{i}" for i in range(2000)]
    codes = np.array([xxhash.xxh64_intdigest(w.encode()) for w in names], np.uint64)
    tail = next(t for t in random.integers(0, 2000, (20_000, 8)) if substrings._rolled(codes[t], 5).min() < 1 << 52)
    heads = np.unique(random.integers(0, 2000, (250_000, 5)), axis=0)
    words = np.hstack([heads, np.repeat(tail[None], len(heads), axis=0)])
    low = substrings._rolled(codes[words].ravel(), 13)[::13].astype("<u4")
    order = np.argsort(low, kind="stable")
    same = np.flatnonzero(low[order][1:] == low[order][:-1])
    assert len(same)
    rows = [(k, " ".join(names[c] for c in words[j])) for k, j in enumerate(x for i in same for x in order[i : i + 2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(frame).collect()] == [0] * len(rows)


def test_repeats_cut_hot_blocks(spark, odd, documents, monkeypatch):
    phrase = "five words of one phrase"
    texts = [f"a{i} b{i} c{i % 50} d{i % 20} e{i % 10} f g h {phrase} p q r s{i % 10} t{i % 20} u{i % 50} v{i} w{i}" for i in range(2000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    monkeypatch.setattr(substrings, "HOT_WINDOWS", 256)
    monkeypatch.setattr(substrings, "SAMPLE", 2)
    hot, windows = substrings._measured(substrings._keyed(frame, "doc_id", "text"))
    assert len(hot) and 0.5 * 2000 * 9 < windows < 1.5 * 2000 * 9
    column = pa.array(texts)
    longest = [max(np.bincount(np.unique(substrings._runs(column, h)[4], return_inverse=True)[1])) for h in (hot[:0], hot)]
    assert longest[1] < longest[0] / 4
    for table in (frame, odd, documents):
        want = brute.repeats(dict((i, t) for i, t in pairs(table) if i is not None).items())
        for least, bucket in ((1, 2_000_000), (256, 5000)):
            monkeypatch.setattr(substrings, "HOT_WINDOWS", least)
            monkeypatch.setattr(substrings, "BUCKET_WINDOWS", bucket)
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(table).collect() if r.doc_id is not None}
            assert got == want


def test_repeats_keep_null_ids_whole(odd):
    row = substrings.remove_repeats(odd).where("doc_id is null").first()
    assert row.n_removed == 0 and row.kept.startswith("no id shared0")


def test_pii_whole_addresses_and_secrets():
    """Proposals reach from the first letter to the last, however long."""
    def offered(text):
        return {text[s:e] for s, e, _, _ in pii.proposals(text)}

    for name in ("n" * 50, "n" * 5000):
        assert f"{name} [at] host [dot] example [dot] org" in offered(f"write to {name} [at] host [dot] example [dot] org now")
    host = ".".join(["part"] * 9) + "." + "x" * 30
    assert f"me(at){host}" in offered(f"at me(at){host} ok") and f"a @ {'h' * 60}.org" in offered(f"a @ {'h' * 60}.org")
    assert "hunter22!restofsecret9" in offered("password=hunter22!restofsecret9 and") and "two words 12345 long" in offered('password = "two words 12345 long", then')
    assert "abcdef123456789" in offered("Authorization: Bearer abcdef123456789 sent")
    began = time.process_time()
    pii.proposals("x" * 2_000_000 + "@" + "@" * 100_000 + "password=" * 50_000)
    assert time.process_time() - began < 20


def test_pii_redacts_whole_secrets(spark):
    texts = [f"note {i} password=hunter{i}!rest{i}x and call +1 555 010 {1000 + i} or see key=value, user{i}@host.example.org" for i in range(60)] + [f"plain words colour: bluegreen{i}, size={i}0000000 and section: seventeen" for i in range(120)]
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for text, secret in (("see password=hunter22!restofsecret9 here", "restofsecret9"), ('set password = "two words 12345 long" there', "12345"), ("Authorization: Bearer abcdef123456789 sent", "abcdef")):
        assert secret not in pii.redact(text, pii.find_spans([text], model)[0][1])



def test_warc_round_trip(spark, data):
    big = "<p>" + "same words " * 200 + "</p>"
    odd = spark.createDataFrame([(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", big), (5, "u", big), (None, "u", big), (6, "u", "WARC/1.1\r\n\r\n" * 200)], "page_id long, url string, html string")
    for pages in (odd, spark.read.parquet(f"{data}/pages.parquet"), odd.limit(0)):
        rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
        owner: dict = {}
        for i, b in rows:
            if len(b) >= 1000 and i is not None:
                owner[b] = max(i, owner.get(b, i))
        want = [(i, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", owner[b]) if b in owner and owner[b] != i else ("response", None))) for i, b in rows]
        got = warc.round_trip(pages).collect()
        assert {r.kind for r in got} <= {"record"}
        assert by_id((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == by_id(want)


def test_warc_salvage(spark):
    path = shared_path(spark, "warc-test")
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i} " + "x" * 50 + "</p>") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, path)
    data = bytes(spark.read.format("binaryFile").load(path).first().content)
    ids = lambda found: [warc._page(h.get("warc-record-id")) for k, _, _, h, _, _ in found if k == "record"]
    assert ids(warc.salvage(data)) == list(range(20))
    at = data.index(b"<urn:page:7>")
    for broken in (data[:at] + b"\xff\xfe" + data[at + 9 :], data.replace(b"<p>7 ", b"<p>8 ")):
        found = list(warc.salvage(broken))
        assert ids(found) == [i for i in range(20) if i != 7]
        gaps = [x for x in found if x[0] == "gap"]
        assert len(gaps) == 1 and gaps[0][1] <= at < gaps[0][1] + gaps[0][2]
    cuts = [i for i in range(len(data)) if data.startswith(b"WARC/1.1\r\n", i)] + [len(data)]
    members = [gzip.compress(data[a:b]) for a, b in zip(cuts, cuts[1:])]
    assert ids(warc.salvage(b"".join(members))) == list(range(20))
    members[3] = members[3][:-9]
    found = list(warc.salvage(b"junk" + b"".join(members) + b"tail"))
    assert ids(found) == list(range(20)) and sum(x[0] == "gap" for x in found) == 3  # all of the record had come out
    members[3] = members[3][:-60]
    found = list(warc.salvage(b"junk" + b"".join(members) + b"tail"))
    assert ids(found) == [i for i in range(20) if i != 3] and sum(x[0] == "gap" for x in found) == 3


def test_warc_of_other_writers():
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"

    def record(name, digest=None, body=block):
        line = f"WARC-Block-Digest: {digest}\r\n" if digest else ""
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\n{line}Content-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    own = hashlib.sha1(block)
    good = ["sha1:" + base64.b32encode(own.digest()).decode(), "SHA1:" + own.hexdigest().upper(), "sha256:" + hashlib.sha256(block).hexdigest(), "blake3:xyz", None]
    data = b"".join(record(i, d) for i, d in enumerate(good)) + record("bad", "sha1:" + base64.b32encode(b"x" * 20).decode())
    found = list(warc.salvage(data))
    assert [f[3].get("warc-record-id") for f in found if f[0] == "record"] == [f"<urn:uuid:{i}>" for i in range(len(good))]
    assert [f[5] for f in found if f[0] == "gap"] == ["block digest differs"]


def test_warc_members_take_time_in_proportion():
    random = np.random.default_rng(2)
    body = random.bytes(20_000).hex().encode()
    one = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a:b>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n", 1)
    took = []
    for n in (500, 4000):
        began = time.process_time()
        assert sum(kind == "record" for kind, *_ in warc.salvage(one * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]
    found = list(warc.salvage(gzip.compress(bytes(50 << 20)) + one))
    assert [f[0] for f in found] == ["gap", "record"] and found[0][5] == "no version line"
    assert [f[0] for f in warc.salvage(gzip.compress(one))] == ["gap"]


def a_record(i, body):
    digest = hashlib.sha1(body).hexdigest()
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_warc_member_of_any_size_is_read_record_by_record():
    body = b"x" * (1 << 20)
    archive = gzip.compress(b"".join(a_record(i, b"%d" % i + body) for i in range(140)), 1)
    assert len(archive) < 1 << 20
    most = 0
    for i, (kind, at, length, headers, block, _) in enumerate(warc.salvage(archive)):
        most = max(most, length)
        assert (kind, at, headers["warc-record-id"], block) == ("record", 0, f"<urn:page:{i}>", b"%d" % i + body)
    assert i == 139 and most < 2 << 20


def test_warc_records_of_a_damaged_member():
    random = np.random.default_rng(5)
    bodies = [random.integers(97, 123, 400, np.uint8).tobytes() for _ in range(200)]
    archive = bytearray(gzip.compress(b"".join(a_record(i, b) for i, b in enumerate(bodies))))
    archive[len(archive) // 2] ^= 1
    found = list(warc.salvage(bytes(archive) + gzip.compress(a_record(200, b"next"))))
    ids = [int(h["warc-record-id"][10:-1]) for k, _, _, h, _, _ in found if k == "record"]
    assert len(set(ids)) == len(ids) >= 90 and ids[-1] == 200 and ids == sorted(ids)
    assert all(block == ([*bodies, b"next"])[int(h["warc-record-id"][10:-1])] for k, _, _, h, block, _ in found if k == "record")
    assert any(k == "gap" and at == 0 and length == len(archive) for k, at, length, *_ in found)


def test_warc_of_lines_that_only_look_like_records_takes_linear_time():
    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        assert [f[0] for f in warc.salvage(b"WARC/1.1\r\n" * n)] == ["gap"]
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0]


def test_warc_damaged(spark, data):
    rows = registry.warc_damaged(spark, data).collect()
    ids = {r.page_id for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id").collect()}
    spoiled = {i for i in ids if i % 10 in (3, 7)}
    assert sorted(r.page_id for r in rows if r.kind == "record") == sorted(ids - spoiled)
    gaps = [r for r in rows if r.kind == "gap"]
    assert 0 < len(gaps) <= len(spoiled) and {r.reason for r in gaps} == {"no version line", "no end mark after the block"}


def test_warc_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    monkeypatch.setattr(warc, "FILE_RECORDS", 10)
    pages = spark.createDataFrame([(i, None, f"{i} " + "x" * (30_000 if i % 5 == 0 else 100)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = shared_path(spark, "bounded")
    warc.write_archives(pages, path)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert max(sizes) < 110_000 and len(sizes) >= 7
    assert sorted(r.page_id for r in warc.read_archives(spark, path).collect()) == list(range(40))


def test_neighbours(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").limit(400)
    held = [(r.vec_id, r.embedding) for r in rows.collect()]
    want = brute.neighbours(held, {i for i, _ in held if i % 20 == 0}, 20)
    frame = spark.createDataFrame(held, "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in vptree.nearest(frame, frame.where("vec_id % 20 = 0"), 20, 1.0, 3).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert {q: [v for v, _ in x] for q, x in found.items()} == {q: [v for v, _ in x] for q, x in want.items()}
    relaxed = vptree.nearest(frame, frame.where("vec_id % 20 = 0"), 20, registry.FACTOR, 3).collect()
    hits = sum((r.vec_id in {v for v, _ in want[r.query_id]}) for r in relaxed)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    held = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [1.0, inf]), (100, [1.0, None]), (120, []), (3, [2.0, 1.0, 0.0]), (4, [-1.0, 5.0]), (140, [0.0, 1.0]), (140, [0.0, 1.0]), (None, [1.0, 1.0])]
    held += [(1000 + i, [0.5, 0.5]) for i in range(200)]
    frame = spark.createDataFrame(held, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vptree.nearest(frame, frame.where("vec_id % 20 = 0"), 5, 1.0, 2).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {0: [1, 2, 1000, 1001, 1002], 140: [4, 1000, 1001, 1002, 1003]} | {q: got[q] for q in got if q >= 1000}
    assert vptree.nearest(frame.limit(0), frame, 5, 1.0, 1).count() == 0


def test_toxicity(spark):
    plain = ["river", "stone", "window", "paper", "garden", "letter", "music", "bridge", "market", "winter", "harbour", "summer"]
    random = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(600):
        words = [plain[j] + plain[k] for j, k in random.integers(0, len(plain), (60, 2))]
        bad = i % 4 == 0
        for at in random.integers(0, 60, 4) if bad else ():
            words[at] = ("zorgblat", "mivquek")[at % 2] + plain[at % 12]
        texts.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    texts += [(1000, None), (1001, ""), (None, "river"), (1002, "mivquek " * 20_000)]
    docs, marks = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    rows = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(rows) == len(texts) and all(0 <= s <= 1 for s in rows.values())
    held = [r.doc_id for r in docs.where(toxicity.held_out(docs["doc_id"])).collect() if r.doc_id is not None and r.doc_id < 1000]
    assert sum((rows[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert rows[1000] == rows[1001] < 0.5 and toxicity.fit(docs, marks.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_mixing(odd, documents):
    means = {r.source: r.mean for r in mixing.source_means(documents).collect()}
    many = mixing.replicate(documents, epochs=300.0).selectExpr("source", "length(text) as n").groupBy("source").agg({"n": "sum"}).collect()
    total = sum(r[1] for r in many)
    assert all(abs(r[1] / total * len(means) - 1) < 0.05 for r in many) and len(many) == len(means)
    got = mixing.replicate(documents, epochs=3.0)
    assert got.columns == [*documents.columns, "mix_copy", "mix_key"]
    sizes = {r.source: r.n for r in got.groupBy("source").agg({"n_chars": "sum"}).withColumnRenamed("sum(n_chars)", "n").collect()}
    assert means and sum(sizes.values()) > 0
    again = mixing.replicate(documents.repartition(3), epochs=3.0)
    assert by_id(got.select("doc_id", "mix_copy", "mix_key").collect()) == by_id(again.select("doc_id", "mix_copy", "mix_key").collect())
    only = mixing.replicate(odd, {"a": 2.0, "b": 1.0}, epochs=4.0).collect()
    assert {r.source for r in only} <= {"a", "b"} and max(r.mix_copy for r in only) >= 1
    assert mixing.replicate(odd.withColumn("mix_key", odd["lang"]), {}).count() == 0


def test_mixing_brings_rare_sources_to_their_weight(spark):
    rows = [(i, "x" * 11_100, f"s{i}") for i in range(9)] + [(100 + i, "x", "rare") for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.source: round(r.mean) for r in mixing.source_means(frame).collect()}["rare"] == 100
    got = [(r.doc_id, r.mix_copy) for r in mixing.replicate(frame).where("source = 'rare'").collect()]
    assert len(set(got)) == len(got) and 9_500 < len(got) < 10_500
    counts = [sum(i == d for d, _ in got) for i in range(100, 200)]
    assert 50 < np.var(counts) < 170


def test_mixing_sql(spark, odd):
    rare = [(1000 + i, "x" * 300, "en", "c", 1) for i in range(400)] + [(2000 + i, "xyz", "en", "rare", 1) for i in range(20)]
    frame = odd.where("doc_id <> 13 or doc_id is null").unionByName(spark.createDataFrame(rare, odd.schema))
    documents = frame.toArrow()  # noqa: F841
    want = duckdb.sql(registry.ORACLES["op10_poisson_mixing"]).fetchall()
    got = mixing.replicate(frame)
    assert by_id(want) == by_id(got.collect()) and got.where("source = 'rare'").agg({"mix_copy": "max"}).first()[0] > 64


def test_empty_tables(spark, none):
    assert quality.ledger(none).count() == simhash.near_duplicates(none).count() == pii.detect(none, None).count() == 0
    assert tokenfiles.round_trip(none).count() == packing.pack_documents(none).count() == substrings.remove_repeats(none).count() == 0
    assert mixing.replicate(none).count() == toxicity.score(none, None).count() == simhash.keep_one(none).count() == 0
    assert [r.n_failed for r in quality.ablations(quality.ledger(none), "strict-1").collect()] == [0] * len(quality.RULES)


def test_clashing_columns(documents):
    extra = documents.withColumn("simhash", documents["lang"]).withColumn("n_words", documents["lang"]).withColumn("spans", documents["lang"]).withColumn("component_id", documents["lang"]).withColumn("__part", documents["lang"])
    n = documents.count()
    assert quality.ledger(extra).count() == pii.detect(extra, None).count() == simhash.near_duplicates(extra).count() == n
    assert quality.filter_quality(extra).columns == simhash.keep_one(extra).columns == extra.columns
    assert quality.filter_quality(extra).where("n_words = lang").count() == quality.filter_quality(extra).count() > 0
    assert quality.ledger(documents.withColumn("N_Words", documents["lang"])).agg({"n_words": "max"}).first()[0] > 0
    assert packing.pack_documents(extra).select("doc_id").distinct().count() == substrings.remove_repeats(extra).count() == n
