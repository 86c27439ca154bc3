"""The ten operators against brute force, exact round trips or held-out accuracy, on small and on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocktide.llm import fingerprints, langid, media, minhash, mixing, packing, pii, queries, sharding, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket string, rep string, band string, chunk string"
LONG = " ".join(f"word{i * i % 977} of{i % 13}" for i in range(9000))
AWKWARD = [
    (1, None, None, None, None), (2, "", "aa", "s", 0), (3, "   \t\n", "aa", "s", 5), (4, "one", None, "s", 3), (5, "one", "aa", None, 3),
    (6, LONG, "aa", "s", len(LONG)), (7, LONG + " end", "aa", "s", 1), (7, LONG + " end", "aa", "s", 1), (8, "é" * 300, "bb", "s", 300), (9, "é" * 300 + "ü", "bb", "s", 301),
    (10, "write to ann@example.org or +49 (30) 123456-78, 10.0.0.255 and 4111 1111 1111 1111", "bb", "t", 80), (11, "a" * 500, "bb", "t", 500), (12, "ab" * 400, "bb", "t", 800), (None, "no id at all", "bb", "t", 9), (-5, "one two three four five six", "aa", "t", 27),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "c") for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def least(i):
    return -(1 << 63) if i is None else i


# 1 suffix dedup


def removed_brute(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, least(i)), least(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < least(i):
                gone[k : k + length] = True
        runs = int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def removed_rows(df):
    return [tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


def test_suffix_dedup_is_exact(small):
    rows = pairs_of(small)
    want = by_id(removed_brute(rows, 50))
    assert sum(r[2] for r in want) > 0
    assert by_id(removed_rows(suffix_dedup.removed(small))) == want
    assert by_id(removed_rows(suffix_dedup.removed(small, hot=3))) == want


@pytest.mark.parametrize("hot", [1, 1 << 16])
def test_suffix_dedup_awkward(awkward, empty, hot):
    assert by_id(removed_rows(suffix_dedup.removed(awkward, hot=hot))) == by_id(removed_brute(pairs_of(awkward), 50))
    assert suffix_dedup.removed(empty, hot=hot).count() == 0


def test_suffix_dedup_keeps_frequent_minimizers_out_of_buckets(spark, monkeypatch):
    """A passage that all texts hold in contexts of their own: no bucket gets its fragments together."""
    rng = np.random.default_rng(6)
    noise = lambda: bytes(rng.integers(97, 123, 70).astype(np.uint8)).decode()
    passage = noise()
    docs = spark.createDataFrame([(int(i), noise() + passage + noise()) for i in rng.permutation(300)], "doc_id long, text string")
    kept, keep = {}, suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: kept.setdefault(name, keep(df, name)))
    got = by_id(removed_rows(suffix_dedup.removed(docs, hot=50)))
    assert got == by_id(removed_brute(pairs_of(docs), 50)) and sum(r[2] for r in got) >= 299 * 70
    sizes = sorted(r["count"] for r in kept["fragments"].groupBy("bucket").count().collect())
    assert sum(sizes) > 300 and sizes[-1] < 0.3 * sum(sizes)


def test_minimizers_are_shared_out_evenly():
    text = bytes(np.random.default_rng(7).integers(97, 123, 200_000).astype(np.uint8))
    h = np.unique(suffix_dedup.minimizer_runs([text])[1])
    for shares in (12, 64):
        assert np.bincount(suffix_dedup.share_of(h, shares), minlength=shares).max() < 1.5 * len(h) / shares
    assert (suffix_dedup.share_of(h ^ np.uint64(1), 64) == suffix_dedup.share_of(h, 64)).all()


def test_minimizer_runs_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 97)
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 97 + k, n).astype(np.uint8)) for k, n in ((3, 400), (1, 300), (26, 49), (26, 50), (2, 0), (5, 51), (4, 700))]
    text, h, first, n, _ = suffix_dedup.minimizer_runs(texts)
    got = [(t, a + x) for t, a, k in zip(text.tolist(), first.tolist(), n.tolist()) for x in range(k)]
    assert sorted(got) == [(t, a) for t, x in enumerate(texts) for a in range(len(x) - 49)]
    of = {}
    for t, a, k, value in zip(text.tolist(), first.tolist(), n.tolist(), h.tolist()):
        for x in range(k):
            assert of.setdefault(texts[t][a + x : a + x + 50], value) == value


@pytest.mark.parametrize("limit, block", [(64 << 20, 1 << 20), (64, 7), (0, 1000)])
def test_column_wise_order_is_the_suffix_order(limit, block):
    """In memory, and with columns in files that are read block by block."""
    rng = np.random.default_rng(3)
    fragments = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in rng.integers(1, 60, 80)]
    columns = suffix_dedup.Columns(limit, block)
    who, long, lcp = suffix_dedup.column_wise(fragments, columns)
    got = [fragments[w][len(fragments[w]) - n :] for w, n in zip(who.tolist(), long.tolist())]
    assert got == sorted(got) and len(got) == sum(len(f) + 1 for f in fragments)
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert lcp[1:].tolist() == [common(a, b) for a, b in zip(got, got[1:])]
    assert (columns.files > 0) == (limit < 1 << 20)


# 2 fingerprints


def test_fingerprints(small, awkward, empty):
    for docs in (small, awkward):
        rows = sorted(((i, t or "") for i, t in pairs_of(docs)), key=lambda x: (least(x[0]), x[1]))
        want = []
        for k, (i, t) in enumerate(rows):
            nxt, cut = rows[(k + 1) % len(rows)][1], len(t) // 4
            want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
        got = fingerprints.fingerprints(docs).collect()
        assert by_id(tuple(r[:3]) for r in got) == by_id(want)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        seen, text = {}, defaultdict(set)
        for i, t in rows:
            text[i].add(t)
        for r in got:
            if len(text[r["doc_id"]]) == 1:
                assert seen.setdefault(next(iter(text[r["doc_id"]])), r["fingerprint"]) == r["fingerprint"]
    assert fingerprints.fingerprints(empty).count() == 0


def test_fingerprints_of_ids_far_apart(spark):
    ids = [-(1 << 63), (1 << 63) - 1, 0, 5, -7]
    docs = spark.createDataFrame([(i, f"text number {i} with words {'x ' * 40}") for i in ids] + [(None, "no id")], "doc_id long, text string")
    rows = sorted(((i, t) for i, t in pairs_of(docs)), key=lambda x: (x[0] is not None, x[0] or 0))
    want = [(i, hashlib.sha256((t[: len(t) - len(t) // 4] + rows[(k + 1) % len(rows)][1][: len(t) // 4]).encode()).hexdigest()) for k, (i, t) in enumerate(rows)]
    got = fingerprints.fingerprints(docs).select("doc_id", "edited_sha256").collect()
    assert by_id(tuple(r) for r in got) == by_id(want)


def test_likeness_is_that_of_the_sketches(small):
    """Every figure of the query by brute force over the texts, but for the hash itself, which Spark gives."""
    spark, rows = small.sparkSession, sorted(pairs_of(small))
    words = [[w for w in re.split(r"[ \t-\r]+", (t or "").lower()) if w] for _, t in rows]
    shingled = [{tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in words]
    every = list({s for x in shingled for s in x})
    hashed = {tuple(r["s"]): r["h"] for r in spark.createDataFrame([(list(s),) for s in every], "s array<string>").select("s", F.xxhash64("s").alias("h")).collect()}
    limit = -(1 << 63) + (1 << 62) - 1
    kept = [{h for h in hs if h <= limit} or ({min(hs)} if hs else set()) for hs in ({hashed[s] for s in x} for x in shingled)]
    got = {r["doc_id"]: r for r in queries.op2_fingerprints(spark, SF).collect()}
    for k, (i, _) in enumerate(rows):
        a, b = kept[k], kept[(k + 1) % len(kept)]
        assert got[i]["fingerprint"] == "".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(a))
        assert abs(got[i]["near_next"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9


def test_sketches_estimate_and_merge(spark):
    a, b = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(2000, 8000))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.merged(F.col("a"), F.col("b")).alias("m"), "a", "b").first()
    assert abs(r["j"] - 0.25) < 0.04 and abs(r["c"] - 0.5) < 0.05 and r["m"] == sorted({*r["a"], *r["b"]})


# 3 language


def test_language_held_out(spark):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").where("held_out").select("doc_id", "lang_pred", "score")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and n_chars > 100").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) > 100 and sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.93


def test_language_awkward(awkward, empty):
    got = langid.predict(awkward, langid.train(awkward)).collect()
    assert len(got) == len(AWKWARD) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert {r["lang_pred"] for r in langid.predict(awkward, langid.train(empty)).collect()} == {"und"}
    assert langid.predict(empty, langid.train(awkward)).count() == 0


def test_language_scores_are_bayes(spark):
    docs = spark.createDataFrame([(1, "aba abb", "x"), (2, "ccd dcd", "y"), (3, "abc", "y")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    counts = {}
    for text, lang in (("aba abb", "x"), ("ccd dcd", "y"), ("abc", "y")):
        for n, g in enumerate(langid._grams([text])[0], 1):
            counts.setdefault(lang, Counter()).update(g[: len(text) + 3 - n].tolist())
    want = {lang: (counts[lang][b] + 0.5) / (sum(counts[lang].values()) + 0.5 * langid.BUCKETS) for lang in "xy" for b in [5]}
    assert np.allclose(np.exp(model.log_prob[:, 5]), [want["x"], want["y"]]) and np.allclose(np.exp(model.log_prior), [2 / 5, 3 / 5])


# 4 toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    assert len(got) > 30 and right > 0.9


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 5, 10, 11)] + [(None, 1), (4, None), (999, 1)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for marks in (labels, none):
        got = toxicity.score(awkward, toxicity.train(awkward, marks)).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_toxic_words_of_a_small_language_count(spark):
    """Recall on toxic and false alarms on clean documents, by language: one has under 2 % of the toxic documents."""
    rng = np.random.default_rng(4)
    toxic_words = {"big": [f"bad{k}" for k in range(6)], "small": [f"mal{k}" for k in range(6)]}

    def document(lang, toxic):
        words = [f"{lang}{k}" for k in rng.integers(0, 300, 40)] + toxic_words[lang] * toxic
        return " ".join(rng.permutation(words).tolist())

    kinds = [("big", 1, 400, 50), ("big", 0, 2000, 200), ("small", 1, 7, 20), ("small", 0, 200, 100)]
    rows = [(lang, toxic, k < learned) for lang, toxic, learned, held in kinds for k in range(learned + held)]
    docs = spark.createDataFrame([(i, document(lang, toxic), lang, toxic) for i, (lang, toxic, _) in enumerate(rows)], "doc_id long, text string, lang string, toxic int")
    labels = spark.createDataFrame([(i, toxic) for i, (_, toxic, learns) in enumerate(rows) if learns], "doc_id long, toxic int")
    scored = toxicity.accept(toxicity.score(docs.join(labels, "doc_id", "left_anti"), toxicity.train(docs, labels), keep=("lang", "toxic")))
    share = {(r["lang"], r["toxic"]): r["p"] for r in scored.groupBy("lang", "toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert min(share["big", 1], share["small", 1]) > 0.9 and max(share["big", 0], share["small", 0]) < 0.05, share


def test_every_toxic_chain_is_learned_from():
    """Words that only stand in the last of more than 4000 toxic chains get their weight."""
    rng = np.random.default_rng(5)
    plain = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 500, n))
    early = [" ".join(f"bad{rng.integers(3)} {plain(toxicity.CHAIN - 1)}" for _ in range(2)) for _ in range(2100)]
    late = [f"{plain(5)} mal {plain(20)}" for _ in range(100)]
    field = toxicity.fit([plain(20) for _ in range(500)] + early + late, [0] * 500 + [1] * 2200, [1.0] * 2700, steps=4)
    assert field.own[field.vocabulary["mal"]] > 0 and field.own[field.vocabulary["bad0"]] > 0


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    e, move, mask = rng.normal(size=(1, 5)), rng.normal(size=(2, 2)), np.ones((1, 5), bool)
    total, p = 0.0, np.zeros(5)
    for s in range(32):
        y = [s >> k & 1 for k in range(5)]
        w = np.exp(sum(e[0, k] * y[k] for k in range(5)) + sum(move[y[k], y[k + 1]] for k in range(4)))
        total += w
        p += w * np.array(y)
    assert np.allclose(toxicity.marginals(e, mask, move)[0][0], p / total)


# 5 near duplicates


def shingles(text, words):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}


def near_brute(rows, words, percent):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, words)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and i != j and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets]


@pytest.mark.parametrize("words", [4, 5])
def test_near_groups(small, words):
    got = [tuple(r) for r in minhash.near_groups(small, words=words).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    want = near_brute(pairs_of(small), words, 80)
    assert len({r[2] for r in want}) < len(want) and by_id(got) == by_id(want)


def test_near_groups_chains_without_a_centre(spark):
    """Edits that add up: neighbours are alike, ends aren't, and no member is like all others."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"new{k}" if k < 5 * step else w for k, w in enumerate(base)) for step in range(12)]
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [tuple(r) for r in minhash.near_groups(docs, words=4).collect()]
    assert by_id(got) == by_id(near_brute(pairs_of(docs), 4, 80))


def test_near_groups_awkward(awkward, empty):
    got = [tuple(r) for r in minhash.near_groups(awkward).collect()]
    assert by_id(got) == by_id(near_brute(pairs_of(awkward), 5, 80))
    assert minhash.near_groups(empty).count() == 0


# 6 media


def test_media_round_trip(spark, awkward, empty):
    rows = media.payload_rows(awkward)
    keep = ("doc_id", "n_bytes")
    found = media.resolve(media.interleave(rows, keep=keep), media.media_store(rows), keep=keep).where("kind = 'media'").collect()
    want = []
    for i, t in pairs_of(awkward):
        raw = (t or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert by_id((r["doc_id"], r["n_bytes"], *r["media"][:3]) for r in found) == by_id(want)
    assert media.media_store(media.payload_rows(empty)).count() == 0


def test_interleaved_order():
    items = media.parse_html('<p>one<img src="sha256:ab" alt="x">two</p><figure><img src="sha256:cd"><figcaption>cap</figcaption></figure><script>no</script>')
    assert [(x["position"], x["kind"], x["text"] or x["digest"], x["caption"]) for x in items] == [(0, "text", "one", None), (1, "media", "ab", "x"), (2, "text", "two", None), (3, "media", "cd", "cap")]
    assert media.parse_html(None) == []


def test_captions_and_unclosed_elements():
    shown = lambda html: [(x["kind"], x["text"] or x["digest"], x["caption"]) for x in media.parse_html(html)]
    assert shown('<img src="a"><figcaption>far</figcaption>') == [("media", "a", None), ("text", "far", None)]
    assert shown('<figure><img src="a"><p>x</p><figcaption>near</figure>y') == [("media", "a", "near"), ("text", "x", None), ("text", "y", None)]
    assert shown("<figcaption>open") == [("text", "open", None)]
    assert shown("<nav>menu<p>text") == [("text", "menu", None), ("text", "text", None)] and shown("<head><title>t<body>b") == [("text", "b", None)]


def test_sequences_stay_aligned(spark):
    """Several paragraphs and references: order, captions and a missing payload."""
    docs = spark.createDataFrame([(1, "first"), (2, "second")], "doc_id long, text string")
    rows = media.payload_rows(docs)
    digest = {r["doc_id"]: r["digest"] for r in rows.collect()}
    html = f'<p>a</p><figure><img src="sha256:{digest[2]}"><figcaption>two</figcaption></figure><p>b</p><img src="sha256:none" alt="gone"><img src="sha256:{digest[1]}">c'
    pages = spark.createDataFrame([(7, html), (8, None)], "page_id long, html string")
    got = media.aligned(media.resolve(media.interleave(pages), media.media_store(rows))).collect()
    assert [r["page_id"] for r in got] == [7]
    assert [(x["kind"], x["text"], x["caption"], x["media"] and x["media"]["payload_bytes"]) for x in got[0]["items"]] == [("text", "a", None, None), ("media", None, "two", 64), ("text", "b", None, None), ("media", None, "gone", None), ("media", None, None, 64), ("text", "c", None, None)]


# 7 mixing


def test_mixing_meets_its_targets(small):
    got = mixing.mix(small).collect()
    uses = Counter(r["doc_id"] for r in got)
    assert set(uses) == {i for i, _ in pairs_of(small)}
    tokens = defaultdict(int)
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
    whole = sum(tokens.values())
    weight = {r["source"]: r["weight"] for r in got}
    longest = max(r["n_tokens"] for r in got)
    assert all(abs(tokens[s] - weight[s] * whole) <= 2 * longest for s in tokens)
    places = defaultdict(list)
    for r in got:
        places[r["source"], r["block"], r["pass_no"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_mixing_awkward(awkward, empty):
    got = Counter(r["doc_id"] for r in mixing.mix(awkward).collect())
    assert set(got) == {r[0] for r in AWKWARD}
    assert mixing.mix(empty).count() == 0


def test_mixing_keeps_clashing_columns(small):
    docs = small.select("*", F.lit("w").alias("weight"), F.lit("b").alias("block"), F.lit(1).alias("passes"))
    got = mixing.mix(docs, keep=("doc_id", "weight", "block", "passes"))
    assert got.columns == ["doc_id", "doc_weight", "doc_block", "passes", "n_tokens", "weight", "pass_no", "block", "slot"] and got.count() >= docs.count()


def test_temperature_limits():
    a, w = mixing.temperature([1000, 100, 10], target_entropy=0.8)
    assert 0 < a < 1 and abs(-(w * np.log(w)).sum() / np.log(3) - 0.8) < 1e-6
    b, _ = mixing.temperature([1000, 100, 10], target_entropy=0.99, max_repeat=2.0)
    assert b > a


# 8 sharding


def test_sharding(small, awkward, empty):
    for docs in (small, awkward):
        got = sharding.shard(docs).collect()
        want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs_of(docs)]
        assert by_id((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == by_id(want)
        slots, sizes = defaultdict(list), Counter()
        for r in got:
            slots[r["shard"]].append(r["slot"])
            sizes[r["shard"]] += r["size"]
        assert all(sorted(v) == list(range(len(v))) and 0 <= s < 24 for s, v in slots.items())
        assert max(sizes.values()) <= sum(sizes.values()) / 24 + 2 * max(x[1] for x in want)
    assert sharding.shard(empty).count() == 0


# 9 personal data

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p.lstrip("0")[:9] or 0) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 10 <= len(d) <= 15),
)
TRICKY = ["a@b@c.d.e", "..@x.y", "x@y..z", "1.2.3.4.5.6.7.8", "300.1.1.1 255.255.255.255", "0001.2.3.4", "+1 (2) 3.4-5 67890", "++12 345 678 90", "4111-1111-1111-1111 4111 1111 1111 1112", "5" * 40, "é ü@ü.de 日本 a@b.c", "@", "1", "a@b.c@d.e", "+1234567890123456", "12345678901234 1", "1.2.3." + "0" * 5000, "0" * 5000 + "7.1.2.3 " + "9" * 5000]


def base_brute(text):
    kinds = [k for k, _, _ in BASE]
    out = [(m.start(), kinds.index(k), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    return [(a, b, kinds[k]) for a, k, b in sorted(out)]


def test_base_spans(small, awkward):
    texts = [t for d in (small, awkward) for _, t in pairs_of(d)] + TRICKY
    for t in texts:
        assert pii.find_spans(t, None)[0] == base_brute(t), t
    assert sum(len(base_brute(t)) for t in texts) > 20


def test_pii_query(spark):
    got = {r["doc_id"]: r for r in queries.op9_pii(spark, SF).collect()}
    for i, t in pairs_of(spark.read.parquet(f"{SF}/documents.parquet")):
        base = [f"{k}:{a}:{b}" for a, b, k in base_brute(t)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in base) for k in pii.KINDS]


def test_redaction_leaves_no_base_span(small, awkward, empty):
    model = pii.train(small)
    for docs in (small, awkward):
        for r in pii.detect(docs, model, redact=True).collect():
            assert r["redacted"] is None or not base_brute(r["redacted"])
    assert pii.detect(empty, pii.train(empty)).count() == 0


def test_hidden_personal_data_is_added(spark):
    """Spans written to be overlooked are found, dates, versions and amounts are not."""
    rng = np.random.default_rng(9)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    other = lambda: ["on 20%s-0%d-1%d" % (digits(2), *rng.integers(1, 10, 2)), "version %d.%d.%d" % tuple(rng.integers(0, 90, 3)), "for %s.%s euros" % (digits(3), digits(2)), "pages %s-%s" % (digits(2), digits(3)), "item 3%s" % digits(5)][rng.integers(5)]
    plain = lambda: [f"{name()}@{name()}.org", "%d.%d.%d.%d" % tuple(rng.integers(1, 255, 4)), f"+49 30 {digits(7)}"]
    docs = [f"write {rng.choice(plain())} {other()} and {rng.choice(plain())}, {other()} or {other()}" for _ in range(800)]
    model = pii.train(spark.createDataFrame([(x,) for x in docs], "text string"))
    hidden = [(f"{name()} (at) {name()} (dot) org", "email") for _ in range(30)] + [("%d . %d . %d . %d" % tuple(rng.integers(1, 255, 4)), "ip") for _ in range(30)]
    found = [pii.find_spans(f"write {t} please", model)[1] == [(6, 6 + len(t), k)] for t, k in hidden]
    wrong = [pii.find_spans(f"it was {other()} again", model)[1] for _ in range(200)]
    assert np.mean(found) > 0.9 and sum(map(bool, wrong)) <= 4, (np.mean(found), [w for w in wrong if w])


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = pii.calibrate(pii.fit_trees(x[:1500], y[:1500]), x[1500:], y[1500:])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


# 10 packing


def test_packing(small, awkward, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (small, awkward):
        got = packing.packed_documents(docs).collect()
        want = []
        for i, t in pairs_of(docs):
            ids = [*known.encode(t or "", add_special_tokens=False).ids, 2]
            first = (len(ids) - 1) % 1024 + 1
            for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], range(first, len(ids) + 1, 1024))):
                want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
        assert by_id(tuple(r[:5]) for r in got) == by_id(want)
        used = defaultdict(list)
        for r in got:
            used[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(used) <= 1.02 * packing.lower_bound(np.array([r[3] for r in want]), 1024) + 1
    assert packing.packed_documents(empty).count() == 0


def test_ids_of_added_tokens_and_long_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing._Encoder("byte_bpe_50k.json", packing.added_tokens("byte_bpe_50k.json"))
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "a  b<|endoftext|>c", "<|endoftext|", "a" + " " * 1_200_000 + "b", "\n" * 1_500_000, " " * 4096 + "x", " \t" * 3000 + "x y"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == known.encode(text, add_special_tokens=False).ids, text[:20]


def test_lower_bound_holds():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(1, 101, 60)
        assert packing.lower_bound(sizes, 100) <= packing.best_fit_decreasing(sizes, 100).max() + 1
