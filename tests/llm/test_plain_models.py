"""Whole results of op5, op8 and op10 against plain Python versions."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from quarry.llm.queries import URL_RULES
from quarry.llm.quality import DAMP as QUALITY_DAMP
from quarry.llm.quality import quality
from quarry.llm.toxicity import DAMP, FLOORS, SHARED, toxicity, train
from quarry.llm.urls import judge

ORDER = 6


def plain_models(classes, shared=0):
    """One function per class, ``log p(last byte of g | the others)``, by
    dictionaries; orders up to ``shared`` count the n-grams of all classes."""
    level = {ORDER: [Counter() for _ in classes]}
    for counter, texts in zip(level[ORDER], classes):
        for t in texts:
            b = b"\0" * (ORDER - 1) + t.encode()
            counter.update(b[i:i + ORDER] for i in range(len(b) - ORDER + 1))
    for k in range(ORDER - 1, 0, -1):
        seen = [set(c) for c in level[k + 1]]
        if k <= shared:
            seen = [set().union(*seen)] * len(classes)
        level[k] = [Counter(g[1:] for g in s) for s in seen]

    def of_class(c):
        by_context, off = defaultdict(list), {}
        for k in range(1, ORDER + 1):
            n = [sum(v == i for v in level[k][c].values()) for i in (1, 2, 3, 4)]
            d = [0.5] * 3
            if n[0] and n[1]:
                y = n[0] / (n[0] + 2 * n[1])
                d = [min(max(i - (i + 1) * y * (n[i] / n[i - 1] if n[i - 1] else 0), 0.05), i - 0.05) for i in (1, 2, 3)]
            off[k] = d
            for g, v in level[k][c].items():
                by_context[g[:-1], k].append(v)

        @cache
        def p(g):
            k = len(g)
            if k == 0:
                return 1 / 256
            same = by_context.get((g[:-1], k))
            if not same:
                return p(g[1:])
            own = level[k][c].get(g, 0)
            taken = [off[k][min(v, 3) - 1] for v in same]
            return ((own - off[k][min(own, 3) - 1] if own else 0) + sum(taken) * p(g[1:])) / sum(same)

        return lambda g: math.log(p(g))

    return [of_class(c) for c in range(len(classes))]


def windows(text):
    b = b"\0" * (ORDER - 1) + (text or "").encode()
    return [b[i:i + ORDER] for i in range(len(b) - ORDER + 1)]


def fold(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def made(n, seed):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ten", "ra", "é"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    return [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("quantile", [0.99, 0.6])
def test_quality_equals_plain(spark, quantile):
    docs = [(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(made(90, 1))]
    docs += [(100, "#$% !!", "en"), (101, None, "fr"), (102, "", None), (None, "ka lo", "en"), (5, "mi mi mi", "en"),
             (103, "ka ten", "new")]
    labels = [(i, 0 if i % 7 == 0 else 1) for i in range(80)] + [(3, None), (4, 0), (None, 1), (100, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = quality(frame, spark.createDataFrame(labels, "doc_id long, quality int"), quantile=quantile).collect()

    marks = defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None:
            marks[i].append(q)
    good = {i for i, q in marks.items() if min(q) == 1}
    log, = plain_models([[t or "" for i, t, _ in docs if i in good and fold(i) > 0]])
    total = lambda t: sum(map(log, windows(t)))
    size = lambda t: len((t or "").encode())
    held = [(t, g) for i, t, g in docs if i in good and fold(i) == 0]
    average = sum(total(t) for t, _ in held) / sum(size(t) for t, _ in held)
    ppl = lambda t: math.exp(-(total(t) + QUALITY_DAMP * average) / (size(t) + QUALITY_DAMP))
    cut = lambda v: sorted(v)[math.ceil(quantile * len(v)) - 1]
    by_lang = defaultdict(list)
    for t, g in held:
        by_lang[g].append(ppl(t))
    overall = cut([ppl(t) for t, _ in held])
    assert len(by_lang) == 3 and len(got) == len(docs)

    want = sorted((str(i), str(g), ppl(t), cut(by_lang[g]) if g in by_lang else overall) for i, t, g in docs)
    have = sorted((str(r.doc_id), str(r.lang), r.perplexity, r.limit, r.keep) for r in got)
    for w, h in zip(want, have):
        assert w[:2] == h[:2] and math.isclose(w[2], h[2], rel_tol=1e-5) and math.isclose(w[3], h[3], rel_tol=1e-5)
        if abs(w[2] / w[3] - 1) > 1e-4:
            assert h[4] == (w[2] <= w[3])
        else:
            assert h[4] == (h[2] <= h[3])


def test_toxicity_equals_plain(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i, t in enumerate(made(120, 2)):
        toxic = i % 3 == 0
        if toxic and i % 12:
            t += rng.choice([" zwurg", " qixfo zwurg"])
        docs.append((i, t))
        if i % 8:
            labels.append((i, int(toxic)))
    docs += [(500, None), (501, ""), (None, "ka zwurg"), (7, "zwurg zwurg")]
    labels += [(2, 1), (None, 1), (9, None), (999, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity(frame, model, ["doc_id", "text"]).collect()

    marks = defaultdict(int)
    known = {i for i, y in labels if i is not None and y is not None and fold(i) != 0}
    for i, y in labels:
        if i in known and y is not None:
            marks[i] = max(marks[i], y)
    rows = [(fold(i), marks[i], t or "") for i, t in docs if i in known]
    logs = plain_models([[t for f, y, t in rows if f > 1 and y == c] for c in (0, 1)], SHARED)

    def evidence(text, floor):
        each = [logs[1](g) - logs[0](g) for g in windows(text)]
        return sum(v for v in each if abs(v) >= floor) / (len(each) + DAMP)

    def fit(x, y):
        """The same penalised likelihood, climbed by damped gradient steps."""
        scale = float(np.std(x)) or 1.0
        z, w = x / scale, np.zeros(2)
        design = np.stack([z, np.ones_like(z)], 1)
        pull = np.array([0.1, 0.001])
        step = 1 / (np.linalg.norm(design, 2) ** 2 / 4 + 0.1)
        for _ in range(60_000):
            slope = design.T @ (1 / (1 + np.exp(-design @ w)) - y) + pull * w
            w = w - step * slope
            if np.abs(slope).max() < 1e-9:
                break
        p = 1 / (1 + np.exp(-design @ w))
        return -np.mean(np.log(np.where(y == 1, p, 1 - p))), w[0] / scale, w[1]

    y = np.array([c for f, c, _ in rows if f == 1], float)
    assert 0 < y.sum() < len(y)
    fits = {f: fit(np.array([evidence(t, f) for g, _, t in rows if g == 1]), y) for f in FLOORS}
    assert fits[model.floor][0] <= min(v[0] for v in fits.values()) + 1e-6
    _, slope, offset = fits[model.floor]
    prior = min(sum(c for _, c, _ in rows) / len(rows), 0.5)
    assert len(got) == len(docs)
    for r in got:
        want = 1 / (1 + math.exp(-(slope * evidence(r.text, model.floor) + offset))) if r.text else prior
        assert abs(r["__score"] - want) < 1e-3


def plain_judge(pages, rules):
    parsed = []
    for _, url, _ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h) + len(p), h + p, v) for h, p, v in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parsed.append((host, path, max(fits, default=None)))
    counts = Counter()
    for *_, html in pages:
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html or "")
        counts.update(w.lower() for w in re.findall("[A-Za-z]+", text))
    total = sum(counts.values()) + 1.0

    def words(name):
        best = [(0.0, [])]
        for end in range(1, len(name) + 1):
            ways = []
            for start in range(end):
                piece = name[start:end]
                if counts[piece] or end - start == 1:
                    cost = math.log(total / counts[piece]) if counts[piece] else math.log(total) + math.log(1000.0)
                    ways.append((best[start][0] + cost, start, best[start][1] + [piece]))
            cost, _, split = min(ways, key=lambda w: w[:2])
            best.append((cost, split))
        return best[-1][1]

    def tokens(host, path):
        out = []
        for run in re.findall(r"[a-z]+|[0-9]+|[^a-z0-9.\-]+", host):
            out += words(run) if re.fullmatch("[a-z]+", run) else [re.sub("[0-9]+", "0", run)]
        shape = re.sub("[0-9]+", "0", re.sub("[A-Z]", lambda m: m[0].lower(), path))
        return out + re.findall(r"[a-z0-9]+|[^\x00-\x7F]+", shape)

    n, seen = Counter(), {"block": Counter(), "allow": Counter()}
    for host, path, fit in parsed:
        if fit:
            n[fit[2]] += 1
            seen[fit[2]].update(tokens(host, path))
    kinds = len(seen["block"] | seen["allow"])
    size = {v: sum(c.values()) + kinds + 1.0 for v, c in seen.items()}
    weight = lambda t: (math.log((seen["block"][t] + 1) / size["block"])
                        - math.log((seen["allow"][t] + 1) / size["allow"]))
    prior = math.log((n["block"] + 1.0) / (n["allow"] + 1.0))
    for (page, *_), (host, path, fit) in zip(pages, parsed):
        score = prior + sum(map(weight, tokens(host, path)))
        yield page, host, path, fit and fit[1], fit[2] if fit else "block" if score > 0 else "allow", score


def test_urls_equal_plain(spark):
    rng = random.Random(4)
    vocabulary = ["good", "news", "casino", "bad", "tea", "shop", "goods", "newsroom", "sino", "op", "ads"]
    pages = []
    for i in range(150):
        name = "".join(rng.choices(vocabulary, k=rng.randint(1, 3)))
        host = rng.choice(["www.", "m2.", "", "x-"]) + name + rng.choice([".org", ".com", ".net", "é.org", ".ORG"])
        path = rng.choice(["", "/", "/fr/", "/de/", "/es/", "/en/1", "/A/b12/", "/é/z"]) + rng.choice(["", "tea7", "?q=/de/", "#x"])
        html = " ".join(rng.choices(vocabulary, k=rng.randint(0, 8)))
        pages.append((i, f"http://{host}{path}", rng.choice([html, f"<b class='zz'>{html}</b><script>bad</script>", None])))
    pages += [(200, None, "tea"), (201, "", ""), (None, "junk", None), (3, "https://example.org/en/12", "Tea TEA"),
              (202, "http://example.org/es/q", None), (203, "http:///p", None), (203, "http:///p", None)]
    got = judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()
    want = list(plain_judge(pages, URL_RULES))
    assert {w[4] for w in want if w[3] is None} == {"block", "allow"}
    key = lambda r: (*map(str, r[:5]), round(r[5], 6))
    assert sorted(map(key, got)) == sorted(map(key, want))
