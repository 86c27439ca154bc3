"""Exact dedup, source divergence and resampling against brute force, on small and on awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stocktide.llm import divergence, exact_dedup, resampling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest bigint, place string, p double, line string, n string, term string, size int, rank int"
LONG = " ".join(f"word{i * i % 977} Of{i % 13}" for i in range(9000))
TEXTS = [(1, None, None, None), (2, "", "aa", "s"), (3, " \t\n", "aa", "s"), (4, "one", None, "s"), (5, "one", "aa", None), (6, LONG, "aa", "s"), (8, LONG, "aa", "s"), (8, LONG, "aa", "s"), (7, LONG.replace(" ", " \n"), "aa", "t"), (9, "É é ÉA\x00a", "bb", "t"), (None, "one", "aa", "t"), (None, "nobody", "bb", "t"), (None, "nobody", "bb", "t"), (-5, "One\n\none two\nthree four\n", "aa", "u"), (12, "\n" * 50, "aa", "u")]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 1, 2, "x", 0.5, "l", "n", "t", 3, 4) for r in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def copies(spark):
    """A third of the rows are one text, written with other white space each time; the others come in groups of one to nine."""
    texts = ["hot\ttext " + "\n" * (i % 5) + "x" if i % 3 == 0 else f"text {i % 7 * i % 41}" for i in range(3000)]
    return spark.createDataFrame([(5000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(13)


def rows_of(docs, *names):
    return [tuple(r) for r in docs.select(*names).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# 11 exact dedup


def dedup_brute(rows):
    form = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[form(t)].append(i)
    least = {f: min((i for i in ids if i is not None), default=None) for f, ids in groups.items()}
    return ordered((i, least[form(t)], len(groups[form(t)]), hashlib.sha256(form(t).encode()).hexdigest()) for i, t in rows)


@pytest.fixture()
def tiny_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_groups(small, awkward, empty, copies, tiny_batches, fan_in):
    for docs in (small, awkward, copies):
        got = exact_dedup.groups(docs, fan_in=fan_in).collect()
        assert ordered((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == dedup_brute(rows_of(docs, "doc_id", "text"))
        stays = Counter(r["text_sha256"] for r in got if r["kept"])
        assert set(stays.values()) == {1} and set(stays) == {r["text_sha256"] for r in got}  # repeated rows, too: one of each group
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.groups(empty).count() == 0


def test_runs_meet_in_rounds(spark, copies):
    """Each partition of the last round is sorted, digests are in one partition only, and none is there twice."""
    from pyspark.sql import functions as F

    runs = exact_dedup.merged_runs(exact_dedup.records(copies), 12, 4).withColumn("at", F.spark_partition_id()).collect()
    assert exact_dedup.fan(12, 4) == (4, 2) and exact_dedup.fan(211) == (6, 3) and exact_dedup.fan(1) == (2, 1)
    assert len({(r["digest"], r["proof"]) for r in runs}) == len(runs) and sum(r["size"] for r in runs) == copies.count()
    by = defaultdict(list)
    for r in runs:
        assert r["digest"] % 16 == r["pid"] == r["at"]
        by[r["at"]].append((r["digest"], bytes(r["proof"])))
    assert len(by) > 4 and all(v == sorted(v) for v in by.values())


def test_collapse_verifies_and_goes_on_over_batches():
    """Equal digests with other proofs stay apart; a group that spans batches is one entry."""
    proofs = [bytes([k]) * 32 for k in (1, 1, 2, 2, 2, 2)]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in exact_dedup.RUN.split(", ")]
    columns = [[0] * 6, [7] * 6, proofs, [False] * 5 + [True], [3, 9, 1, 2, 5, None], [30, 90, 10, 20, 50, 60], [1, 2, 3, 4, 5, 6]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    for cuts in ([6], [1] * 6, [3, 0, 3], [2, 2, 2]):
        at, parts = 0, []
        for n in cuts:
            parts.append(batch.slice(at, n))
            at += n
        got = [r for b in exact_dedup.collapse(iter(parts)) for r in b.to_pylist()]
        assert [(r["proof"][0], r["id"], r["place"], r["size"]) for r in got] == [(1, 3, 30, 3), (2, 1, 10, 18)]
    assert list(exact_dedup.collapse(iter([batch.slice(0, 0)]))) == []


# 12 divergence


def audit_brute(rows, least, top):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    found = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(low))) for t, lang, source in rows]
    held, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in found:
        held[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang in held:
        kept = sorted(t for t, k in held[lang].items() if k >= least)
        sources = sorted({s for g, s, _ in found if g == lang})

        def shares(counts):
            whole = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (whole + 5 * len(kept)) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 7])
def test_audit(small, awkward, empty, bits):
    """With 7 bits nearly every digest is shared, and every term goes through the splitting."""
    for docs, least, top in ((small, 30, 50), (small, 5, 3), (awkward, 2, 50)):
        want = audit_brute(rows_of(docs, "text", "lang", "source"), least, top)
        assert {r[2] for r in want} == {"pair", "term"}
        assert sorted(tuple(r) for r in divergence.audit(docs, least, top, bits=bits).collect()) == want
    assert divergence.audit(empty, bits=bits).count() == 0


def test_audit_without_kept_terms(small):
    got = divergence.audit(small, 10**6).collect()
    assert got and all(r["part"] == "pair" and r["value"] == 0 for r in got) and sorted(tuple(r) for r in got) == audit_brute(rows_of(small, "text", "lang", "source"), 10**6, 50)


def test_distances_in_blocks(small, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 64)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 10)
    monkeypatch.setattr(divergence, "SLICE", 13)
    assert sorted(tuple(r) for r in divergence.audit(small, 5, 3).collect()) == audit_brute(rows_of(small, "text", "lang", "source"), 5, 3)


def test_ties_at_the_end_of_a_list(spark):
    """All terms of a source have one value: the list ends by their text, not by their digests."""
    docs = [(f"{a}{b} plain", "l", "s") for a in "abcdefghij" for b in "abcdefghij" for _ in range(2)] + [("plain plain", "l", "t")] * 30
    rows = spark.createDataFrame(docs, "text string, lang string, source string")
    got = divergence.audit(rows, 2, 7).where("source = 's' and part = 'term'").orderBy("rank").collect()
    assert [r["item"] for r in got] == ["aa", "ab", "ac", "ad", "ae", "af", "ag"] and len({r["value"] for r in got}) == 1


# 13 resampling


def features_brute(text, grams):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return words, [b" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def resample_brute(rows, target, percent, grams, buckets, least):
    whole, wanted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    made = []
    for _, t in rows:
        words, features = features_brute(t, grams)
        made.append((len(words), [zlib.crc32(f) % buckets for f in features]))
        np.add.at(whole, made[-1][1], 1)
    for t in target:
        np.add.at(wanted, [zlib.crc32(f) % buckets for f in features_brute(t, grams)[1]], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (wanted[k] * 0 + whole.sum() + buckets) / ((whole[k] + 1) * (wanted.sum() + buckets)))) for k, b in enumerate(wanted.tolist())]
    out = []
    for (i, _), (words, features) in zip(rows, made):
        weight = sum(gain[f] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    some = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(some[: percent * len(some) // 100], 1):
        r[4] = k
    return ordered(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("grams", [1, 3])
def test_resampling(spark, small, awkward, empty, grams):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [r["text"] for r in bench.collect()]
    none = bench.where("false")
    for docs, target, percent, least in ((small, bench, 10, 20), (small, none, 25, 1), (awkward, bench, 60, 1)):
        rows = rows_of(docs, "doc_id", "text")
        got = [tuple(r) for r in resampling.resample(docs, target, percent, grams, 10_000, least_words=least).collect()]
        assert ordered(got) == resample_brute(rows, texts if target is bench else [], percent, grams, 10_000, least)
        assert sum(r[4] is not None for r in got) > 0
    assert resampling.resample(empty, bench, grams=grams).count() == 0


@pytest.mark.parametrize("grams", [1, 2, 3, 5])
def test_lines_and_crossing_runs_make_up_the_text(grams):
    rng = np.random.default_rng(grams)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "é", "7", " ", "\n", "-"], 40, p=[0.2, 0.1, 0.1, 0.1, 0.25, 0.2, 0.05])).encode().lower()
        lines = [f for line in text.split(b"\n") for f in resampling.runs(resampling.WORD.findall(line), grams)]
        assert Counter(lines + (resampling.crossing_runs(text, grams) if grams > 1 else [])) == Counter(features_brute(text.decode(), grams)[1])


def test_repeated_lines_are_worked_once(spark):
    """A line in every document, and thousands of times in one: a row of features each, with how often it comes."""
    docs = spark.createDataFrame([("frequent line\n" + ("other line\n" * 3000 if i == 5 else f"own line {i}"),) for i in range(50)], "text string")
    got = {r["occurrences"]: (r["words"], len(r["features"])) for r in resampling.line_features(docs, 1, 100).where("occurrences > 1").collect()}
    assert got == {50: (2, 2), 3000: (2, 2)} and resampling.line_features(docs, 1, 100).count() == 51
