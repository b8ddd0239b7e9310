"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from patchloom.llm import ann, exact_dedup, license_rules, license_scan, mixing, packing, simhash, substring_dedup, token_rollup, toxicity, warc

CLASHING = ("h", "size", "row", "place", "key", "list", "v", "probes", "text_sha256", "digest", "fp", "score", "words", "uid", "spans", "bucket", "kh", "mult", "shard", "mark", "list", "copies", "n", "doc", "i", "__n", "sequence_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(40_000))
TEXTS = [
    (1, "A b  c", "en", "s1", 6),
    (2, "A b\tc", "en", "s1", 6),
    (3, None, "en", None, 0),
    (4, "", None, "s2", 0),
    (None, "A b c", "en", "s1", 5),
    (5, "This is under the MIT License and the Apache License, Version 2.0; mit license mit license.", "en", "s2", 9),
    (5, "This is under the MIT License and the Apache License, Version 2.0; mit license mit license.", "en", "s2", 9),
    (6, LONG, "en", "s1", len(LONG)),
    (7, LONG + " tail", "en", "s3", len(LONG)),
    (8, "é ü ß General PUBLIC license", "fr", "s3", 5),
    (9, " \t\n", "de", "s4", 3),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_exact_dedup(spark, docs, empty):
    got = exact_dedup.exact_dedup(spark, docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        same = [t for t in TEXTS if hashlib.sha256(normal(t[1]).encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same)
        assert r.keep_id == min((t[0] for t in same if t[0] is not None), default=None)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    stay = exact_dedup.keep_first(spark, docs)
    assert stay.columns == docs.columns and stay.count() == len(kept)
    assert all(r[c] == 7 for r in stay.collect() for c in CLASHING)
    assert exact_dedup.exact_dedup(spark, empty).count() == exact_dedup.keep_first(spark, empty).count() == 0


def test_exact_dedup_twice_on_one_index(spark, docs):
    index = exact_dedup.DigestIndex(spark)
    first = exact_dedup.exact_dedup(spark, docs.where("doc_id < 5").select("doc_id", "text"), index).collect()
    assert sum(r.kept for r in first) == len({r.text_sha256 for r in first}) == 2
    second = exact_dedup.exact_dedup(spark, docs.select("doc_id", "text"), index).collect()
    old = {r.text_sha256: r.keep_id for r in first}
    assert len(second) == len(TEXTS) and not any(r.kept for r in second if r.text_sha256 in old)
    assert all(r.keep_id == old[r.text_sha256] for r in second if r.text_sha256 in old)
    assert sorted(r.text_sha256 for r in second if r.kept) == sorted({r.text_sha256 for r in second} - set(old))
    sizes = [r.text_sha256 for r in second]
    assert all(r.group_size == sizes.count(r.text_sha256) for r in second)
    assert not any(r.kept for r in exact_dedup.exact_dedup(spark, docs.select("doc_id", "text"), index).collect())
    index.drop()


def test_exact_dedup_index_grows(spark, docs):
    index = exact_dedup.DigestIndex(spark)
    rows = exact_dedup.digests(docs.where("doc_id < 5").select("doc_id", "text"))
    index.add(rows)
    before = index.read().count()
    index.add(rows)
    assert index.read().count() == before
    index.add(exact_dedup.digests(docs.select("doc_id", "text")))
    assert index.read().count() == len({normal(t[1]) for t in TEXTS})
    index.drop()


def test_mixing(spark, docs, empty):
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(TEXTS)
    sizes = {}
    for t in TEXTS:
        sizes[t[3]] = sizes.get(t[3], 0) + len(re.findall("[^\x20\x09-\x0d]+", t[1] or ""))
    assert sum(r.size for r in got) == sum(sizes.values())
    assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(spark, docs).collect()), key=str)
    out = mixing.mixed_documents(spark, docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(spark, empty).count() == 0


def test_mixing_targets(spark):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 7}", 0) for i in range(3000)] + [(9000 + i, "w " * 3, "en", None, 0) for i in range(40)]
    got = mixing.mix(spark, spark.createDataFrame(rows, SCHEMA)).toPandas()
    by = got.groupby(["source_size", "target"]).agg(taken=("taken", "sum"), size=("size", "sum")).reset_index()
    sources = by["size"] / by.source_size  # sources that share a size and a target
    assert (abs(by.taken - by.target * sources) <= 9).all() and (by.target <= 3 * by.source_size + 1e-9).all()
    total = got["size"].sum()
    assert abs((by.target * sources).sum() - total) < 1e-6 * total


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(spark, docs).collect()
    assert len(got) == len(TEXTS)

    def brute(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))

    assert sorted(((t[0], brute(t[1])) for t in TEXTS), key=str) == sorted(((r.doc_id, r.fp % 2**64) for r in got), key=str)
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[1] == by_id[2] == by_id[None] == 1 or by_id[None] in (1, 3)
    assert by_id[3] == by_id[4] == by_id[9] == 3
    stay = simhash.one_of_each(spark, docs)
    assert stay.columns == docs.columns and all(r[c] == 7 for r in stay.collect() for c in CLASHING)
    assert simhash.near_duplicates(spark, empty).count() == simhash.one_of_each(spark, empty).count() == 0


def test_simhash_files_against_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    f = np.unique(np.array([int(b) ^ int(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, 3, dtype=np.uint64)[: rng.integers(0, 4)], initial=np.uint64(0))) for b in base for _ in range(120)], dtype=np.uint64))
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    a, b = np.nonzero(near)
    want = simhash._forest(len(f), a, b)
    kinds, keys, rows = [], [], []
    for kind, bits in enumerate(simhash.FREE):
        key = (f & np.uint64(~sum(1 << x for x in bits) & (2**64 - 1))).view(np.int64)
        order = np.argsort(key, kind="stable")
        kinds.append(np.full(len(f), kind))
        keys.append(key[order])
        rows.append(f[order])
    left, right = simhash.links_of_files(np.concatenate(kinds), np.concatenate(keys), np.concatenate(rows))
    at = {int(x): i for i, x in enumerate(f)}
    got = simhash._forest(len(f), np.array([at[int(x)] for x in left]), np.array([at[int(x)] for x in right]))
    assert (got == want).all()


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(docs).collect()
    lengths = {}
    for r in got:
        lengths.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in lengths.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        total = sum(n for _, n in pieces)
        assert total <= 2048 and total & (total - 1) == 0
    for doc_id, text in {(t[0], t[1]) for t in TEXTS if t[0] not in (None, 5)}:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist() == ids
        assert {r.doc_tokens for r in parts} == {len(ids)}
    digest = packing.packed_digest(packing.pack(docs)).collect()
    assert {r.ids_crc32 for r in digest} == {zlib.crc32(r.ids) for r in got}
    assert packing.pack(empty).count() == 0


def test_packing_with_loss(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(n)), n % 2 == 0) for i, n in enumerate((3, 900, 4, 50, 61, 700, 2, 0, 33, 1200))] + [(90, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bears boolean")
    whole = {r.doc_id: r.doc_tokens for r in packing.pack(docs).collect()}
    got = packing.pack(docs, tokens=512, segments=3, loss=100, loss_column="bears").collect()
    bears = {r[0]: bool(r[2]) for r in rows}
    sequences, parts = {}, {}
    for r in got:
        assert r.loss_tokens == (r.length if bears[r.doc_id] else 0)
        sequences.setdefault(r.sequence_id, []).append(r)
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
    for pieces in sequences.values():
        total = sum(r.length for r in pieces)
        assert total <= 512 and total & (total - 1) == 0 and len(pieces) <= 3 and sum(r.loss_tokens for r in pieces) <= 100
    assert set(parts) == set(whole)
    for doc_id, pieces in parts.items():
        pieces.sort()
        assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) == whole[doc_id]


def test_packer_respects_all_limits():
    rng = np.random.default_rng(0)
    out = []
    packer = packing.Packer(lambda pieces: out.append([(x, s, n, int(x.loss[s + n] - x.loss[s])) for x, s, n in pieces]), 64, 5, 20, window=16)
    examples = [packing.Example(i, np.arange(n, dtype="<u4"), rng.random(n) < 0.5) for i, n in enumerate(rng.integers(1, 150, 300))]
    for x in examples:
        packer.add(x)
    packer.finish()
    seen = {}
    for sequence in out:
        assert sum(n for _, _, n, _ in sequence) <= 64 and len(sequence) <= 5 and sum(b for *_, b in sequence) <= 20
        for x, s, n, _ in sequence:
            seen.setdefault(x.doc_id, []).append((s, n))
    for x in examples:
        parts = sorted(seen[x.doc_id])
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) == len(x.ids)


def test_license_rules():
    """The gate is exact only if each match holds the keyword of its rule as a word, and suppression if none is longer than LONGEST."""
    for _, _, keyword, pattern in license_rules.rules():
        whole = pattern[4:-2] if pattern.startswith(" (?:") and pattern.endswith(") ") else pattern
        outside = re.sub(r"\(\?:[^()]*\)\??", "", re.sub(r"\(\?:[^()]*\)\??", "", whole))
        for branch in outside.split("|"):
            assert re.search(rf"(?<![a-z0-9]){keyword}(?![a-z0-9?])", branch), pattern
        assert pattern.count("  ") + pattern.count(".{1,40}") * 14 < license_scan.LONGEST, pattern


def test_license_written(spark):
    """Every written rule is found in the words that it spells out, and nothing is found in them with one word put between each two."""
    shown = []
    for label, _, expression in license_rules.WRITTEN:
        text = re.sub(r"\(\?:[^()]*\)\?", "", expression).replace(".{1,40}", "some one").replace("[^ ]{1,8}", "x").replace("licen[sc]e", "licence")
        text = re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", text).replace("[1-4] [05]", "4 0").split("|")[0]
        text = re.sub(r"\w\?", "", text)
        shown.append((label, text))
    rows = [(i, text) for i, (_, text) in enumerate(shown)] + [(1000 + i, " zq ".join(text.split())) for i, (_, text) in enumerate(shown) if " " in text]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in license_scan.license_scan(spark, docs).collect()}
    # a longer rule may contain the match and stand for it
    assert [(s, got[i]) for i, s in enumerate(shown) if got[i] == [""]] == []
    assert sum(s[0] in got[i] for i, s in enumerate(shown)) >= len(shown) - 5
    single = {k for k in got if k >= 1000 and got[k] != [""]}
    assert single <= {1000 + i for i, (_, text) in enumerate(shown) if re.search(r"\b(gplv\d|lgplv\d|agplv\d|wtfpl|odbl|sspl|busl|openrail|beerware|0bsd)\b", text)}


def test_license_scan(spark, docs, empty):
    got = {(r.doc_id, r.n_words): r for r in license_scan.license_scan(spark, docs).collect()}
    r = got[5, 17]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (4, 4, 15, "apache,mit")
    assert {"apache-2.0", "mit", "apache"} <= set(r.labels.split(",")) and 0 < r.score < 1
    assert got[8, 6].base_labels == "gpl" and got[8, 6].first_word == 3
    assert got[3, 0].n_base == 0 and got[3, 0].first_word is None and got[3, 0].labels == ""
    assert license_scan.license_scan(spark, docs).count() == len(TEXTS)
    assert license_scan.license_scan(spark, empty).count() == 0


def test_toxicity(spark, docs, empty):
    from pyspark.sql import functions as F

    rows = [(i, ("foul word here " if i % 3 == 0 else "kind word here ") + str(i), "en", "s", 0) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)] + [(1, 0, 0), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(spark, spark.createDataFrame(rows, SCHEMA), labels).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert ((got.predicted == 1) == (got.doc_id % 3 == 0)).all() and got.score.between(0, 1).all()
    none = labels.limit(0)
    assert toxicity.toxicity(spark, docs, none).where(F.col("score").between(0, 1)).count() == len(TEXTS)
    kept = toxicity.without_toxic(spark, docs, none)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) and all(r[c] == 7 for r in kept.collect() for c in CLASHING)
    assert toxicity.toxicity(spark, empty, labels).count() == 0


def test_token_rollup(spark, docs, empty, tmp_path):
    rows = token_rollup.counted(docs)
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/rollup")
    load = token_rollup.signed(rows, "words", "blank_words", 1)
    assert rollup.commit("a", load) and not rollup.commit("a", load)
    total = rollup.totals().groupBy().sum("documents", "tokens").first()
    assert total[0] == len(TEXTS) and total[1] == sum(len((t[1] or "").split()) for t in TEXTS)
    rollup.compact()
    assert not rollup.commit("a", load)
    assert rollup.totals().groupBy().sum("documents", "tokens").first() == total
    assert len(rollup._commits()) == 1
    rollup.compact()
    assert rollup.committed("a") and not rollup.commit("a", load) and len(rollup._commits()) == 1
    assert rollup.commit("b", token_rollup.signed(rows, "words", "blank_words", -1))
    assert rollup.totals().count() == 0
    assert rollup.commit("c", token_rollup.signed(token_rollup.counted(empty), "words", "words", 1))
    with pytest.raises(ValueError):
        rollup.commit("../x", load)


def test_token_rollup_counts_all_documents(spark, tmp_path):
    rows = [t for t in TEXTS if t[1] != LONG] + [(10, "only four words here", "xx", "short", 20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    texts = [t[1] or "" for t in rows]
    tokens = [len(x) // 4 for x in token_rollup.WordCachedTokenizer.shared(None).encode(texts)]
    want = {}
    for t, x, n in zip(rows, texts, tokens, strict=True):
        for version, count in (("words", len(re.findall(r"\w+", x))), ("word_bpe_49k", n)):
            documents, total = want.get((t[3], t[2], version), (0, 0))
            want[t[3], t[2], version] = documents + 1, total + count
    got = token_rollup.op4_token_rollup(spark, f"file://{tmp_path}").collect()
    assert {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in got} == want and len(got) == len(want)


def test_warc(spark, tmp_path):
    from pyspark.sql import functions as F

    big, huge = "x" * 1200, "long payload " * 300_000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (None, "http://a/n", big + "é"), (2, "http://a/2b", big), (6, "u", ""), (7, "u", huge), (8, "u", huge)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("shard", "mark", "digest", "key", "keeper", "n")})
    folder = f"file://{tmp_path}/one"
    warc.write_warc(spark, pages, folder, file_bytes=300)
    files = sorted(map(tuple, warc.manifest(spark, folder).collect()))
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows) and all(r.body_ok for r in got) and len(files) > 1
    full = [r for r in got if r.payload_bytes == 1200]
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in full), key=str) == [(1, "revisit", 2), (2, "response", None), (2, "revisit", 2)]
    assert {r.payload_digest for r in full} == {hashlib.sha1(big.encode()).hexdigest()}
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == len(huge)), key=str) == [(7, "revisit", 8), (8, "response", None)]
    warc.write_warc(spark, pages.repartition(3), f"file://{tmp_path}/two", file_bytes=300)
    assert sorted(map(tuple, warc.manifest(spark, f"file://{tmp_path}/two").collect())) == files
    import gzip

    heads = [line for f in (tmp_path / "one").glob("part-*.warc.gz") for line in gzip.open(f).read().split(b"\r\n")]
    ids = [x for x in heads if x.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == len(rows)
    assert {x.split(b": ")[1] for x in heads if x.startswith(b"WARC-Refers-To: ")} <= {x.split(b": ")[1] for x in ids}
    warc.write_warc(spark, pages.limit(0), f"file://{tmp_path}/three")
    assert warc.read_warc(spark, f"file://{tmp_path}/three").count() == 0


def test_warc_spreads_one_page_id(spark, tmp_path):
    rows = [(None, "u", f"page {i} " * 20) for i in range(3000)] + [(i, "u", f"own {i}") for i in range(1500)]
    folder = f"file://{tmp_path}/many"
    warc.write_warc(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), folder, shard_bytes=40_000)
    files = [r.records for r in warc.manifest(spark, folder).collect()]
    assert sum(files) == len(rows) and max(files) < 1000
    assert warc.read_warc(spark, folder).where("page_id IS NULL AND body_ok").count() == 3000


def test_substring_dedup(spark, docs, empty):
    def brute(texts, length):
        counts = {}
        for t in texts:
            for i in range(len(t) - length + 1):
                counts[t[i : i + length]] = counts.get(t[i : i + length], 0) + 1
        for t in texts:
            hit = np.zeros(len(t), dtype=bool)
            for i in range(len(t) - length + 1):
                if counts[t[i : i + length]] > 1:
                    hit[i : i + length] = True
            runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
            yield len(t), int(hit.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~hit].tobytes()).hexdigest()

    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(5)]
    texts = ["".join(rng.choice([*base, "a" * rng.randint(0, 40), str(rng.random())]) for _ in range(rng.randint(0, 6))) for _ in range(120)]
    texts += [base[0] + base[1] + str(i) * 3 for i in range(30)] + ["é" * 40, "", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for length, k, group in ((20, 5, 256), (20, 5, 4)):
        got = substring_dedup.remove_repeats(spark, df, length, k, group).orderBy("doc_id").collect()
        assert [tuple(r)[1:5] for r in got] == list(brute([t.encode() for t in texts], length))
    got = substring_dedup.remove_repeats(spark, docs).collect()
    assert len(got) == len(TEXTS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].n_removed == len(LONG) and by_id[7].n_removed == len(LONG) and by_id[3].n_bytes == 0
    assert substring_dedup.remove_repeats(spark, empty).count() == 0


def test_ann(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    v = rng.standard_normal((700, 16))
    v[100:130] = v[100]
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(700)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(7) for c in ("v", "list", "probes", "n", "block", "ask", "rank", "score")})
    got = ann.search(spark, df).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 700, 50):
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(700), -np.round(s, 12)))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 5 and (mine.score.diff().dropna() <= 0).all()
        assert np.allclose(mine.score, s[mine.vec_id], atol=1e-12)
        hits += len(set(want) & set(mine.vec_id))
    assert hits >= 0.9 * 70
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist() == [101, 102, 103, 104, 105]
    assert ann.search(spark, df.limit(0)).count() == 0
    few = ann.search(spark, df.where("vec_id IN (0, 1, 2)"))
    assert few.count() == 2
    assert ann.search(spark, df.where("vec_id IN (0, 1, 2, 3, 4, 5, 6)")).count() == 5


def test_ann_extreme_and_uneven_vectors(spark):
    rows = [(0, [1e-200, 0.0, 0.0]), (1, [1e200, 1e200, 0.0]), (2, [0.0, 5e-324, 0.0]), (3, [1e308, 1e308, 1e308]), (4, [-1.0, 0.0, 0.0])]
    rows += [(50, [1.0, 0.0]), (51, [1.0, 1.0]), (52, [0.0, -2.0]), (100, [3.0])]
    got = [tuple(r) for r in ann.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    near = [(0, 1, 1, 1 / np.sqrt(2)), (0, 2, 3, 1 / np.sqrt(3)), (0, 3, 2, 0.0), (0, 4, 4, -1.0), (50, 1, 51, 1 / np.sqrt(2)), (50, 2, 52, 0.0)]
    assert [g[:3] for g in got] == [n[:3] for n in near] and np.allclose([g[3] for g in got], [n[3] for n in near], atol=1e-15)
