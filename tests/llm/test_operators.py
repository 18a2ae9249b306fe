"""Each operator against brute force on small data, and on rows with nulls, empty texts, ties and clashing columns."""

import hashlib
import json
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loglode.llm import chat_pairs, common, decontaminate, license_scan, packing, quality_rules, repeats, simhash, substring_dedup, suffix_dedup, token_files, tokens, toxicity
from loglode.llm.registry import ORACLES, QUERIES

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def documents(seed=1, n=60):
    """Rows with shared passages, copies, nulls, an empty and a long text, repeated ids, and clashing columns."""
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(k))
    shared = [text(40), text(90)]
    rows = []
    for i in range(n):
        parts = [text(r.randrange(1, 80))]
        if r.random() < 0.4:
            parts.insert(r.randrange(2), r.choice(shared))
        if r.random() < 0.2:
            parts.append("é\n" * r.randrange(300))
        rows.append((i, r.choice([" ", "\n"]).join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (n + 3, ""), (n + 4, text(3000) + " " + shared[1]), (n + 5, "a b " * 700), (5, rows[7][1]), (5, rows[7][1]), (None, rows[9][1])]
    return rows


def frame(spark, rows):
    data = [(i, t, "en", f"s{k % 3}", 7, k, "x", "y") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, batch int, anchor string, fp string").repartition(3)


def ordered(rows):
    return sorted(rows, key=lambda x: (-(1 << 63) if x[0] is None else x[0], x[1] or ""))


def brute_words(rows, k):
    seen, out = set(), []
    for i, t in ordered(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            if key in seen:
                gone[a : a + k] = [True] * k
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_bytes(rows, k):
    data = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[a : a + k] for _, b in data for a in range(len(b) - k + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for a in range(len(b) - k + 1):
            if n[b[a : a + k]] > 1:
                gone[a : a + k] = b"\1" * k
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("limit", [8192, 1])
def test_substring_dedup(spark, limit):
    rows = documents()
    got = substring_dedup.substring_dedup(frame(spark, rows), group_limit=limit).drop("kept_text").collect()
    assert Counter(map(tuple, got)) == brute_words(rows, 20)


@pytest.mark.parametrize("limit", [8192, 1])
def test_suffix_dedup(spark, limit):
    rows = documents()
    got = suffix_dedup.suffix_dedup(frame(spark, rows), group_limit=limit).drop("spans", "kept_text", "text_sha256").collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 400)


def test_fm_index_matching_statistics():
    r = np.random.default_rng(0)
    texts = [r.integers(1, 5, n).astype(np.uint64) for n in (50, 3, 120)]
    queries = [r.integers(1, 7, n).astype(np.uint64) for n in (40, 80)]
    index = substring_dedup.FMIndex(texts, 6)
    strings = ["".join(map(str, t)) for t in texts]
    for j, live, have, lo, hi in index.matching(queries):
        for q, m, a, b in zip(live, have, lo, hi):
            s = "".join(map(str, queries[q]))
            at = len(s) - 1 - j
            best = max(k for k in range(7) if any(s[at : at + k] in t for t in strings) and at + k <= len(s))
            assert m == best
            if m:
                assert b - a == sum(t[x : x + m] == s[at : at + m] for t in strings for x in range(len(t)))


@pytest.mark.parametrize("block", [1 << 20, 64, 7])
def test_columnwise_bwt(tmp_path, block):
    r = random.Random(3)
    strings = ["".join(r.choice("ab") for _ in range(r.randrange(1, 40))).encode() for _ in range(30)] + [b"abab", b"abab"]
    built = suffix_dedup.ColumnwiseBWT(strings, 8, str(tmp_path), block)
    suffixes = sorted((s[a:], a == len(s), i) for i, s in enumerate(strings) for a in range(len(s) + 1))
    bwt, lcp = built.read()
    assert len(bwt) == len(suffixes)
    common = [0] + [min(8, len(__import__("os").path.commonprefix([a[0], b[0]]))) for a, b in zip(suffixes, suffixes[1:])]
    assert lcp.tolist() == common
    n = Counter(s[a : a + 8] for s in strings for a in range(len(s) - 7))
    for s, marks in zip(strings, built.windows()):
        assert marks.tolist() == [n[s[a : a + 8]] > 1 for a in range(len(s) - 7)]


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for i in range(64):
            n[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * n[i] > len(shingles))


@pytest.mark.parametrize("limit", [20_000, 2])
def test_simhash(spark, limit):
    rows = [x for x in documents(2) if x[0] is not None]
    base = random.Random(5)
    text = " ".join(base.choice(WORDS) + str(base.randrange(99)) for _ in range(400)).split()
    for k in range(60):  # near copies of one text
        t = list(text)
        t[base.randrange(400)] = f"x{k}"
        rows.append((1000 + k, " ".join(t)))
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_components(frame(spark, rows), group_limit=limit).collect()}
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = {f: f for _, f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for i, f in fps:
        low[find(f)] = min(i, low.get(find(f), i))
    assert got == {(i, f"{f:016x}"): low[find(f)] for i, f in fps}


def test_simhash_forest_of_large_groups():
    r = np.random.default_rng(1)
    fp = np.unique(np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 24, (300, 3)).astype(np.uint64), axis=1))
    a, b = simhash.links_of(np.zeros(len(fp), np.int64), fp, 2)
    assert len(a) < len(fp)
    parts = {int(x): {int(x)} for x in fp}
    for x, y in zip(a.tolist(), b.tolist()):
        assert (x ^ y).bit_count() <= 2
        if parts[x] is not parts[y]:
            parts[x] |= parts[y]
            for z in parts[y]:
                parts[z] = parts[x]
    for x in fp.tolist():
        assert all(parts[x] is parts[y] for y in fp.tolist() if (x ^ y).bit_count() <= 2)


def test_decontaminate(spark):
    r = random.Random(4)
    items = [(i, " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(r.choice([2, 4, 9, 30, 200])))) for i in range(40)] + [(40, None), (41, ""), (42, "..."), (None, "one lone item without any id at all here")]
    rows = documents(4)
    for i in range(30):
        words = re.findall(r"\w+", r.choice(items[:40])[1])
        if i % 3 == 0:
            words[r.randrange(len(words))] = "changed"
        filler = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(r.choice([10, 2000]))]
        at = r.randrange(len(filler))
        rows.append((500 + i, " ".join(filler[:at] + [w.upper() + "," for w in words] + filler[at:])))
    rows.append((600, "One lone item, without any id at all; here!"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 10):
        got = Counter((x.doc_id, x.item_id, x.n_shingles, x.n_shared) for x in decontaminate.contaminated(frame(spark, rows), bench, block=block).collect())
        want = Counter()
        for d, t in rows:
            w = decontaminate.words_of(t)
            for i, q in items:
                v = decontaminate.words_of(q)
                k = min(5, len(v))
                if k:
                    grams = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)}
                    shared = len(grams & {tuple(w[a : a + k]) for a in range(len(w) - k + 1)})
                    if shared >= 0.8 * len(grams):
                        want[d, i, len(grams), shared] += 1
        assert got == want


def test_decontaminate_many_small_items():
    """A text that quotes 1,000 of 20,000 tiny items finds them all in bounded memory."""
    import tracemalloc

    r = random.Random(1)
    items = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(5))) for i in range(20_000)]
    ensemble = decontaminate.Ensemble(items, 5, 0.8, 1e-9)
    tracemalloc.start()
    found = {x[0] for x in ensemble.matches(" ".join(t for _, t in items[:1000]))}
    assert found == set(range(1000)) and {x[0] for x in ensemble.matches(items[7][1])} == {7}
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_optimal_bounds():
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 9):
        lengths = np.sort(r.choice(np.arange(1, 60), n, replace=False))
        counts = r.integers(1, 20, n)
        for k in (1, 2, 4):
            bounds = packing.optimal_bounds(lengths, counts, k)
            waste = lambda b: sum(int(c) * (min(x for x in b if x >= size) - int(size)) for size, c in zip(lengths, counts))
            import itertools

            best = min(waste([*c, lengths[-1]]) for m in range(min(k, n)) for c in itertools.combinations(lengths[:-1], m))
            assert len(bounds) <= k and waste(bounds) == best
    assert packing.optimal_bounds(np.zeros(0, int), np.zeros(0, int), 4) == []


def test_packing(spark):
    rows = documents(6)
    got = packing.pack(packing.token_counts(frame(spark, rows), tokens.tokenizer_path()), budget=2048, buckets=4, rows_per_shard=16).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in rows)
    assert Counter((x.doc_id, x.n_tokens) for x in got) == want
    batches = {}
    for x in got:
        assert x.n_tokens <= x.padded_to
        batches.setdefault(x.batch_id, []).append(x)
    assert len({x.padded_to for x in got}) <= 4
    for b in batches.values():
        assert sorted(x.slot for x in b) == list(range(len(b))) and {x.batch_rows for x in b} == {len(b)}
        assert len({x.padded_to for x in b}) == 1 and (len(b) == 1 or len(b) * b[0].padded_to <= 2048)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_piece_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    encoder = tokens.PieceEncoder(tokens.tokenizer_path(), limit=50)
    r = random.Random(7)
    texts = ["", None, " ", "  a", "a  b", "a \n b", "é \t x  ", "a  b", "x\x1c y", " lead", "don't  'll go", "<|endoftext|> a", "日本 語  x", "Été, (a) it's ça!! x.y ., ª² a٣ 'll", "\u0301a b\u0301", " é", "．x", "Ⅷ ⅷ ǅ"]
    texts += ["".join(r.choice([" ", "  ", "\n", "\t", "a", "B", "1", "é", "'s", "!", " ", "\x85"]) for _ in range(30)) for _ in range(300)]
    for x in texts:
        assert encoder.encode_slice(pa.array([x], pa.string()))[1].tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = documents(8)
    manifest = token_files.write_token_files(frame(spark, rows), f"file://{tmp_path}/out", tokens.tokenizer_path(), length=128, sequences=4, rows_per_file=20)
    got = Counter(map(tuple, token_files.read_token_files(manifest).collect()))
    t, at, want, stream = Tokenizer.from_file(tokens.tokenizer_path()), 0, Counter(), []
    for i, x in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
        stream.append(ids)
    assert got == want
    seen = []
    for m in manifest.orderBy("part").collect():
        f = token_files.SequenceReader(m.path)
        for i in range(-(-m.n_tokens // 128)):
            ids, mask = f.sequence(i)
            mask = np.unpackbits(mask, bitorder="little")
            assert len(ids) == len(mask) == 128 and ids.base is not None
            seen.append(ids[mask == 1])
    assert np.concatenate(seen).tolist() == np.concatenate(stream).tolist()
    empty = token_files.write_token_files(frame(spark, rows).limit(0), f"file://{tmp_path}/none", tokens.tokenizer_path())
    assert token_files.read_token_files(empty).count() == 0


def peak_mb(make):
    tracemalloc.start()
    out = make()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_workers_hold_little(monkeypatch):
    r = np.random.default_rng(3)
    docs = [np.unique(r.integers(0, 20_000, 900)).astype(np.uint32) for _ in range(3_000)]
    labels = r.integers(0, 2, (3_000, 2))
    chosen, peak = peak_mb(lambda: toxicity.choose_features(docs, labels, 50))
    every = Counter(f for d in docs for f in d.tolist())
    best = {f: 0.0 for f, n in every.items() if n >= 3}
    for y in labels.T:
        some, n1 = Counter(f for d, k in zip(docs, y) if k for f in d.tolist()), int(y.sum())
        for f in best:
            n, share = every[f], every[f] / 3_000
            z = abs(some[f] / n1 - (n - some[f]) / (3_000 - n1)) / math.sqrt(share * (1 - share) * (1 / n1 + 1 / (3_000 - n1)))
            best[f] = max(best[f], z)
    assert list(chosen) == sorted(best, key=lambda f: (-best[f], f))[:50]
    assert peak < 40  # 2.6 million occurrences at once took 8 bytes each several times over
    text = bytes(r.integers(97, 123, 6 << 20).astype(np.uint8))
    unit = repeats.Unit(False, 400, 320)
    hashes = unit.hashes([text])
    n, peak = peak_mb(lambda: sum(int(x[2].sum()) for x in repeats.runs(unit, hashes, content=True)))
    assert n == len(text) - 399 and peak < 40
    given = []
    monkeypatch.setattr(common, "release", lambda: given.append(1))
    assert len(list(common.slices(pa.array(["x" * 600_000] * 5)))) == len(given) == 5


def test_toxicity_held_out(spark):
    r = random.Random(9)
    bad = ["vile", "rotten", "foulness", "foulest"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(WORDS) + r.choice(["", "s", "ly"]) for _ in range(60)]
        toxic, poor = r.random() < 0.3, r.random() < 0.3
        if toxic:
            w[5:5] = r.sample(bad, 2)
        if poor:
            w[9:9] = ["junkword"]
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, 0 if poor else 1, int(toxic)))
    truth = {i: any(b in t.split() for b in bad) for i, t in rows}
    rows += [(900, None), (901, ""), (None, "x")]
    table = spark.createDataFrame([*labels, (1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(frame(spark, rows), table).collect()}
    assert len(got) == 603
    held = [i for i in truth if i >= 400]
    assert sum(got[i].toxic == truth[i] for i in held) >= 0.99 * len(held)
    assert not got[900].toxic and not got[901].toxic
    copies = toxicity.toxicity(frame(spark, rows + rows[:1] * 400 + rows[7:8]), table).collect()
    assert len(copies) == len(rows) + 401 and all((x.toxic, x.p_toxic) == (got[x.doc_id].toxic, got[x.doc_id].p_toxic) for x in copies)
    none = toxicity.toxicity(frame(spark, rows), table.limit(0)).collect()
    assert len(none) == 603 and not any(x.toxic for x in none)


def test_stale_answers_with_ties_and_nulls(spark, tmp_path):
    a, u = "assistant", "user"
    rows = [
        ("t", 1, a, "second"), ("t", 1, a, "first"), ("t", 2, u, "why"), ("t", 3, a, "b"), ("t", 3, a, "a"), ("t", 4, u, "cut"),
        ("n", None, a, "early"), ("n", None, u, None), ("n", 2, None, "x"), ("n", 2, a, None), ("o", 5, a, "only"), ("o", 5, a, "only"), ("s", 1, u, "no answer"),
        (None, 1, a, "p"), (None, 1, u, "q"), (None, 2, a, "r"), (None, 2, a, "r"),
    ]
    conversations = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    mine = chat_pairs.preference_pairs(chat_pairs.stale_answer_pairs(conversations))
    db = duckdb.connect()
    db.register("conversations", conversations.toArrow())
    theirs = db.sql(ORACLES["op5_preference_format"])
    assert sorted(map(repr, map(tuple, mine.select(*theirs.columns).collect()))) == sorted(map(repr, theirs.fetchall()))
    tied = {r.pair_id: r for r in mine.collect()}["t"]
    assert (tied.n_prompt_turns, tied.rejected.count("first"), tied.chosen.count("\n")) == (3, 2, 4)


def test_preference_pairs(spark):
    turns = [("p", s, i, r, t) for s, last in (("chosen", "good"), ("rejected", "bad")) for i, (r, t) in enumerate([("system", None), ("user", "hi"), ("assistant", last)])]
    turns += [("q", "chosen", 0, "user", "a"), (None, "chosen", 0, None, "a"), (None, "rejected", 0, None, "a")]
    got = {x.pair_id: x for x in chat_pairs.preference_pairs(spark.createDataFrame(turns, "pair_id string, side string, turn long, role string, text string")).collect()}
    p = got["p"]
    assert p.prompt == "<|system|>\n\n<|user|>\nhi\n" and p.n_prompt_turns == 2
    assert p.chosen == "<|assistant|>\ngood\n" and p.rejected == "<|assistant|>\nbad\n"
    a, b = map(int, p.chosen_loss.split("-"))
    assert p.chosen[a:b] == "good"
    assert got["q"].prompt == "" and got["q"].rejected == "" and got["q"].chosen == "<|user|>\na\n"
    assert got[None].prompt == "<||>\na\n" and got[None].chosen == got[None].rejected == ""


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit.update((i, i + 1, i + 2))
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_quality_rules(spark):
    rows = documents(10) + [(700, "# $ " * 30 + " é😀 x\n\n \nx\nx"), (701, "\x0b\x0c a a a a")]
    got = quality_rules.quality_rules(frame(spark, rows)).collect()
    assert Counter(tuple(x)[:7] for x in got) == Counter((i, *brute_quality(t)) for i, t in rows)
    assert not any(x.kept for x in got if x.base_failed)


def test_quality_outliers(spark):
    r = random.Random(11)
    rows = []
    for i in range(400):
        w = [r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(r.randrange(80, 300))]
        if i >= 380:
            w = [x + "###$$$%%%" for x in w]
        rows.append((i, " ".join(w)))
    data = [(i, t, "en", None if i % 2 else "big") for i, t in rows]
    got = {x.doc_id: x for x in quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == 400
    assert not any(got[i].kept for i in range(380, 400))
    assert sum(got[i].kept for i in range(380)) >= 377
    # The estimate against a plain computation of the same steps.
    x = np.array([[math.log(got[i].word_chars / got[i].n_words), math.asin(math.sqrt(min(1, got[i].n_symbols / got[i].word_chars))), 0.0, math.asin(math.sqrt(got[i].n_repeat_words / got[i].n_words))] for i in range(0, 400, 2)])
    centre = np.quantile(x, 0.5, axis=0, method="inverted_cdf")
    spread = np.quantile(np.abs(x - centre), 0.5, axis=0, method="inverted_cdf") * 1.4826
    cov, scale = np.diag(spread**2), 1.0
    for _ in range(4):
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov * scale + 0.05**2 * np.eye(4)), x - centre)
        near = x[d <= np.quantile(d, 0.75, method="inverted_cdf")]
        centre, cov = near.mean(axis=0), np.cov(near.T, bias=True)
        scale = 0.75 / quality_rules._chi2(quality_rules._chi2_quantile(0.75, 2), 3)
        last = d
    assert np.allclose([got[i].d2 for i in range(0, 400, 2)], last, rtol=1e-6)


def test_license_sentences_have_triggers_and_rules_use_known_ids():
    known = dict(license_scan.SENTENCES)
    assert all(re.search(license_scan.TRIGGERS, s) or "is provided as is" in s for s in known.values())
    assert all(re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", s) for s in known.values())
    assert all(i in known for _, ids in license_scan.RULES for i in ids)


def test_license_scan(spark):
    rows = [(1, "x y.\nLicensed under the Apache License, Version 2.0.\nz"), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nCopyright, all rights reserved."), (5, "Released under the MIT License. Released under the MIT License."), (None, "SPDX-License-Identifier: MIT")]
    got = {x.doc_id: x for x in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert (got[1].licenses, got[1].n_sentences, got[1].unknown_ids) == ("Apache-2.0", 1, "")
    assert got[2].licenses == got[3].licenses == "" and got[2].n_sentences == 0
    assert (got[4].licenses, got[4].unknown_ids, got[4].n_sentences) == ("Apache-2.0", "rights-reserved", 3)
    assert (got[5].licenses, got[5].n_sentences, got[5].unknown_ids) == ("MIT", 2, "")


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLES[name])
    assert canonical(cur.fetchall(), [d[0] for d in cur.description]) == canonical(df.collect(), df.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, sf_dir, tmp_path, name):
    for t in ("documents", "conversations", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    names = corpus_pipeline.COLUMNS
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.collect()
        if name == "suffix-array dedup":
            assert docs.columns == names and len(after) == len(before)
            cut = brute_bytes([(x.doc_id, x.text) for x in before], 250)
            changed = {x[0] for x in cut if x[2]}
            assert {x.doc_id for x in after if x.text != {y.doc_id: y.text for y in before}[x.doc_id]} == changed
        elif i < 4:
            assert docs.columns == names and set(after) <= set(before)
        else:
            assert sorted(x.doc_id for x in after) == sorted(x.doc_id for x in before)
        if name == "simhash near-dedup":
            fps = sorted((x.doc_id, brute_fingerprint(x.text)) for x in after)
            assert all((a[1] ^ b[1]).bit_count() > 2 for k, a in enumerate(fps) for b in fps[:k])
        sizes.append(len(after))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[4] == sizes[5] > 0
