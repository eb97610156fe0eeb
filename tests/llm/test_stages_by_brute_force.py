"""Language ID and every stage of the pipeline against plain versions of their own input."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from cohortscore.llm import langid, queries
from cohortscore.llm.common import stored

from ..conftest import SF
from . import brute
from .test_operators import _check_packing, _targets


def _grams(text):
    """Hashed n-gram counts by whole numbers, one byte at a time."""
    raw, counts = text.lower().encode(), Counter()
    for n in range(1, 5):
        for i in range(len(raw) - n + 1):
            h = 0
            for byte in raw[i : i + n]:
                h = (h * 0x01000193 + byte) % 2**32
            counts[(h * 0x9E3779B1) % 2**32 >> 20] += 1
    size = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(c) / size for k, c in counts.items()} if size else {}


def _vote(vote, x):
    """(class, probability): each pair of classes multiplies two sigmoids of its margin."""
    p = dict.fromkeys(vote.classes, 1.0)
    for (a, b), w in zip(combinations(vote.classes, 2), vote.weights, strict=True):
        margin = min(max(3 * (sum(float(w[k]) * v for k, v in x.items()) + float(w[-1])), -30), 30)
        p[a] *= 1 / (1 + math.exp(-margin))
        p[b] *= 1 / (1 + math.exp(margin))
    best = max(sorted(p), key=lambda c: p[c])
    return best, p[best] / sum(p.values())


def _language(model, text):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    x = _grams(text)
    family, p = _vote(model.family, x)
    lang, q = _vote(model.within[family], x)
    return lang, p * q


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return [[r.asDict() for r in d.collect()] for d in out], langid.fit(docs)


def test_language_of_every_document(spark, stages):
    (docs, *_), model = stages
    text = {d["doc_id"]: d["text"] for d in docs}
    got = queries.op3_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        lang, score = _language(model, text[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)


def test_first_stage(stages):
    (docs, known, *_), model = stages
    want = {d["doc_id"]: d | {"lang": d["lang"] if d["lang"] is not None else _language(model, d["text"])[0]} for d in docs if d["text"] and any(c.isalpha() for c in d["text"])}
    assert {d["doc_id"]: d for d in known} == want and len(known) == len(want)


def _without_repeats(docs, least=20):
    """Texts in the order of ids; every run of lines that first reaches ``least`` characters is deleted where it stood before."""
    lines = {d["doc_id"]: d["text"].split("\n") for d in docs}
    seen, dead = set(), defaultdict(set)
    for doc in sorted(lines):
        own = lines[doc]
        for i in range(len(own)):
            size, j = -1, i
            while j < len(own) and size < least:
                size, j = size + len(own[j]) + 1, j + 1
            if size >= least:
                run = tuple(own[i:j])
                if run in seen:
                    dead[doc].update(range(i, j))
                seen.add(run)
    return {doc: "\n".join(x for i, x in enumerate(own) if i not in dead[doc]) for doc, own in lines.items() if not dead[doc] or any(re.search(r"\S", x) for i, x in enumerate(own) if i not in dead[doc])}


def test_second_stage(stages):
    (_, known, lines, *_), _ = stages
    want = _without_repeats(known)
    assert {d["doc_id"]: d["text"] for d in lines} == want and len(lines) == len(want) < len(known) + 1
    before = {d["doc_id"]: d for d in known}
    assert all(d["n_chars"] == len(d["text"]) for d in lines if d["text"] != before[d["doc_id"]]["text"])
    assert all((d["lang"], d["source"]) == (before[d["doc_id"]]["lang"], before[d["doc_id"]]["source"]) for d in lines)


def test_third_stage(stages):
    (_, _, lines, near, *_), _ = stages
    roots = brute.components([brute.shingles(d["text"]) for d in lines])
    groups = defaultdict(set)
    for d, root in zip(lines, roots, strict=True):
        groups[root if brute.shingles(d["text"]) else ("alone", d["doc_id"])].add(d["doc_id"])
    stay = {d["doc_id"] for d in near}
    assert len(near) == len(groups) and all(len(g & stay) == 1 for g in groups.values())
    before = {d["doc_id"]: d for d in lines}
    assert all(d == before[d["doc_id"]] for d in near)


def test_fourth_stage(stages):
    (_, _, _, near, mixed, _), _ = stages
    size = {d["doc_id"]: len(brute.words(d["text"])) for d in near}
    source = {d["doc_id"]: d["source"] for d in near}
    text = {d["doc_id"]: d["text"] for d in near}
    of_source, taken, words = Counter(), Counter(), Counter()
    for doc, n in size.items():
        of_source[source[doc]] += n
    for d in mixed:
        n = len(brute.words(d["text"]))
        taken[source[d["doc_id"]]] += n
        words[d["doc_id"]] += n
        assert n <= size[d["doc_id"]] and " ".join(brute.words(d["text"])) in " ".join(brute.words(text[d["doc_id"]]))
    assert all(words[doc] <= 2 * n for doc, n in size.items())
    for s, t in _targets(dict(of_source)).items():
        assert abs(taken[s] - t) <= 8


def test_last_stage(spark, stages):
    (*_, mixed, packed), _ = stages

    class Row(dict):
        pass

    sequences, least = _check_packing([Row(r) for r in packed], [(d["doc_id"], d["text"]) for d in mixed])
    assert least <= sequences <= least + max(2, least // 50)
    assert np.sum([r["length"] for r in packed]) > 0
