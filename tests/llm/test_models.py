"""The fitted operators against plain versions: label probabilities by enumeration, compressed sizes one by one, rules one by one."""

import itertools

import numpy as np
import pandas as pd
import pytest
import zstandard
from comparison import SF

from tidewire.llm import compression_quality, crf_language, url_rules


def enumerated(scores, transitions):
    """Of one text: the log of the sum over all labellings, each word's probabilities, and the expected transitions."""
    n, k = scores.shape
    total, single, steps = 0.0, np.zeros((n, k)), np.zeros((k, k))
    for labels in itertools.product(range(k), repeat=n):
        w = np.exp(sum(scores[t, x] for t, x in enumerate(labels)) + sum(transitions[a, b] for a, b in zip(labels, labels[1:])))
        total += w
        for t, x in enumerate(labels):
            single[t, x] += w
        for a, b in zip(labels, labels[1:]):
            steps[a, b] += w
    return np.log(total), single / total, steps / total


def test_forward_backward():
    rng = np.random.default_rng(4)
    lengths = np.array([5, 4, 4, 1])
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    scores, transitions = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    steps = np.zeros((3, 3))
    p = crf_language.marginals(scores, offsets, lengths, transitions, steps)
    each = [enumerated(scores[o : o + n], transitions) for o, n in zip(offsets, lengths)]
    assert np.allclose(p, np.concatenate([x[1] for x in each]))
    assert np.allclose(steps, sum(x[2] for x in each))
    # The expected transitions are the slope of the log of the sum over labellings.
    for i, j in itertools.product(range(3), repeat=2):
        moved = transitions.copy()
        moved[i, j] += 1e-6
        rise = sum(enumerated(scores[o : o + n], moved)[0] for o, n in zip(offsets, lengths)) - sum(x[0] for x in each)
        assert rise / 1e-6 == pytest.approx(steps[i, j], abs=1e-4)


def test_code_switched_text():
    words = {x: [f"{x}{c}{d}{x}" for c in "abcdefgh" for d in "klmnop"] for x in ("q", "z", "y")}
    rng = np.random.default_rng(5)
    runs = [(x, [words[x][i] for i in rng.integers(0, 48, 40)]) for _ in range(60) for x in words]
    model = crf_language.trained(runs)
    labeller = crf_language.Labeller(model)
    rows = labeller.index(" ".join(words["q"][:20] + words["z"][:20] + words["y"][:20]))
    (_, _, means) = labeller.label([" ".join(words["q"][:20] + words["z"][:20] + words["y"][:20])])[0]
    p = crf_language.marginals(labeller.scores[rows], np.array([0]), np.array([60]), model.transitions)
    assert (p.argmax(axis=1) == np.repeat([model.languages.index(x) for x in "qzy"], 20)).all()
    assert means == pytest.approx([1 / 3] * 3, abs=0.05)


def test_every_language_is_learned(spark):
    """One language of a few short texts beside one of many and of long ones."""
    rows = [(i, "lorem ipsum dolor sit amet " * 400, "aa") for i in range(40)] + [(100 + i, f"kala vesi puu talo {i}", "bb") for i in range(3)]
    model = crf_language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("aa", "bb")


def test_scores_are_those_of_the_sizes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, label int")
    model = compression_quality.fit(compression_quality.labelled(docs, labels))
    rows = compression_quality.scored(docs, model).collect()

    def size(data, dictionary):
        made = zstandard.ZstdCompressor(level=compression_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(made.compress(data[i : i + compression_quality.BLOCK])) for i in range(0, len(data), compression_quality.BLOCK))

    for r in rows[:40]:
        data = (r["text"] or "").encode()
        good, bad = size(data, model.good), size(data, model.bad)
        difference = (bad - good) / (bad + good) if data else 0.0
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-((difference - model.shift) / model.scale * model.slope + model.constant))), rel=1e-9)
    one = compression_quality.fit(compression_quality.labelled(docs, labels.filter("label = 1")))
    assert compression_quality.scored(docs, one).select("score").distinct().count() == 1


def test_first_blocks(spark):
    rows = spark.range(5000).selectExpr("id as i", "id as h", "xxhash64(id) as order")
    found = [r["i"] for r in compression_quality._first(rows, 5000, 300, ["order", "h", "i"]).collect()]
    assert found == [r["i"] for r in rows.orderBy("order", "h", "i").limit(300).collect()]


def test_host_rules_through_the_index(spark):
    """Every rule against every URL, one by one."""
    rules = (*url_rules.HOST_RULES, ("block", "a-b.example.org", "/x/y"), ("allow", "example.org", "/x/yz"), ("block", "é.fr", ""))
    hosts = ["net", "a.net", "xnet", "example.net", "w.Example.NET", "example.com", "a-b.example.org", "q.a-b.example.org", "b.example.org", "o.example.org", "é.fr", "a.é.fr", "k.org", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/x", "/EN/", "/de/?q", "/fr/#f", "/x/y", "/x/yz", "/x/yy/z?en/")] + [None, "", "net/", "a://b://net/"]
    found = {r["page_id"]: r for r in url_rules.judged(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), host_rules=rules, pattern_rules=()).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h), len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, "allow", None))
        assert (found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) == (host, path, best[3], best[2]), url
