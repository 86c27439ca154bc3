"""Language scores, toxicity scores and the mix, worked out again in plain Python, without the operators' own parts."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stocktide.llm import langid, mixing, toxicity

SF = "/root/testdata/sf0.001"
WORD32 = (1 << 32) - 1


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def gram_buckets(text):
    """Buckets of all 1- to 3-grams of a text framed by spaces, by the recurrence of the hash."""
    points = [ord(c) for c in f" {text.lower()} "]
    h = [p * 0x9E3779B1 & WORD32 for p in points]
    out = [x >> 17 for x in h]
    for n in (2, 3):
        h = [(x * 0x85EBCA6B + points[k + n - 1] * 0xC2B2AE35 + n) & WORD32 for k, x in enumerate(h[:-1])]
        out += [((x ^ x >> 15) * 0x2C1B3C6D & WORD32) >> 17 for x in h]
    return out


def test_language_scores_worked_out_again(spark, small):
    rows = [(r["doc_id"], (r["text"] or "")[:400], r["lang"]) for r in small.orderBy("doc_id").collect()]
    rows += [(-1, None, "en"), (-2, "12 !", "en"), (-3, "", None), (-4, "x", None), (-5, "ŧŋđ ħĸ " * 9, "zz"), (-6, "ŧŋđ ħĸ " * 9, "yy"), (-7, "ŧŋđ ħĸ " * 9, "yy"), (-8, "ŧŋđ ħĸ " * 9, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, texts = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(gram_buckets(text))
            texts[lang] += 1
    langs = sorted(counts)
    whole = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    prior = {x: math.log((texts[x] + 1) / sum(n + 1 for n in texts.values())) for x in langs}
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    for i, text, _ in rows:
        if not text or not any(map(str.isalpha, text)):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        logs = {x: prior[x] + sum(math.log((counts[x][b] + 0.5) / whole[x]) for b in gram_buckets(text)) for x in langs}
        best = max(langs, key=lambda x: logs[x])  # the first of equal ones
        p = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert abs(got[i]["score"] - p) < 1e-6, i
        if sorted(logs.values())[-1] - sorted(logs.values())[-2] > 1e-6:
            assert got[i]["lang_pred"] == best
    assert got[-5]["lang_pred"] == "yy"  # as likely in yy as in zz


def toxic_score(field, text):
    """Forward and backward over one chain, in probabilities."""
    words = re.findall(toxicity.WORD.pattern, text.lower())
    ids = [field.vocabulary.get(w, 0) for w in words]
    n = len(ids)
    e = [math.exp(field.bias + field.own[x] + (field.left[ids[k - 1]] if k else 0.0) + (field.right[ids[k + 1]] if k + 1 < n else 0.0)) for k, x in enumerate(ids)]
    move = [[math.exp(field.move[a][b]) for b in (0, 1)] for a in (0, 1)]
    forward = [(1.0, e[0])] if n else []
    for k in range(1, n):
        a = forward[-1]
        x, y = a[0] * move[0][0] + a[1] * move[1][0], e[k] * (a[0] * move[0][1] + a[1] * move[1][1])
        forward.append((x / (x + y), y / (x + y)))
    back, p = (1.0, 1.0), [0.0] * n
    for k in range(n - 1, -1, -1):
        x, y = forward[k][0] * back[0], forward[k][1] * back[1]
        p[k] = y / (x + y)
        back = tuple(move[s][0] * back[0] + move[s][1] * e[k] * back[1] for s in (0, 1))
        back = tuple(b / sum(back) for b in back)
    top = min(max(max(p, default=0.0), 1e-4), 1 - 1e-4)
    z = (1.0, math.log(top / (1 - top)), math.log1p(sum(p)))
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, field.layer)))), p


def test_toxicity_scores_worked_out_again(spark):
    """Texts of one chain each; labels of the small tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert not isinstance(field, float)
    odd = sorted(field.vocabulary, key=lambda w: -field.own[field.vocabulary[w]])[:5]
    texts = [" ".join((r["text"] or "").split()[:30]) for r in docs.orderBy("doc_id").limit(60).collect()] + ["", odd[0], " ".join(odd), f"a {odd[1]} b c {odd[2]}, {odd[0]} d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(rows, field).collect()}
    some = 0
    for k, text in enumerate(texts):
        want, p = toxic_score(field, text)
        if len(p) > toxicity.STEP:
            continue
        some += 1
        assert abs(got[k]["score"] - want) < 1e-6, (k, text)
        assert sum(len(re.findall(toxicity.WORD.pattern, text[s["start"] : s["stop"]].lower())) for s in got[k]["spans"]) == sum(x > 0.5 for x in p)
    assert some > 50


def test_the_mix_worked_out_again(small):
    """Weights from a search of another kind; who is in the partial pass from the order of blocks and hashes."""
    rows = small.select("doc_id", "source", "text", F.xxhash64(F.lit(0), "doc_id", "text").alias("h")).collect()
    tokens, n = Counter(), Counter()
    words = {r["doc_id"]: len([w for w in re.split("[ \t-\r]+", r["text"] or "") if w]) for r in rows}
    for r in rows:
        tokens[r["source"]] += words[r["doc_id"]]
        n[r["source"]] += 1
    sources = [s for s in tokens if tokens[s]]
    whole = sum(tokens.values())

    def weights(a):
        w = {s: (tokens[s] / whole) ** a for s in sources}
        return {s: x / sum(w.values()) for s, x in w.items()}

    def repeat(w):
        budget = max(tokens[s] / w[s] for s in sources)
        return max(budget * w[s] / tokens[s] for s in sources)

    least = 0.97 * math.log(len(sources))
    grid = [k / 2000 for k in range(2001)]
    a = max(x for x in grid if -sum(w * math.log(w) for w in weights(x).values()) >= least - 1e-9)
    if repeat(weights(a)) > 4.0:
        a = min(x for x in grid if x >= a and repeat(weights(x)) <= 4.0)
    got = mixing.mix(small).collect()
    exact = {r["source"]: r["weight"] for r in got}
    assert all(abs(exact[s] - weights(a)[s]) < 2e-3 for s in sources)
    budget = max(tokens[s] / exact[s] for s in sources)
    uses, block = Counter(r["doc_id"] for r in got), {r["doc_id"]: r["block"] for r in got}
    for s in sources:
        passes = math.floor(budget * exact[s] / tokens[s] + 1e-9)
        partial, upto = (budget * exact[s] / tokens[s] - passes) * tokens[s], 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (r["h"] % max(1, -(-n[s] // mixing.BLOCK_ROWS)), r["h"])):
            t = words[r["doc_id"]]
            upto += t
            more = partial > 1e-6 and t > 0 and upto - t / 2 <= partial
            assert uses[r["doc_id"]] == passes + more and block[r["doc_id"]] == r["h"] % max(1, -(-n[s] // mixing.BLOCK_ROWS))
