"""Each operator on odd rows, on an empty table, and against a plain version."""

import hashlib
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortscore.llm import ann, common, jaccard, langid, licenses, linededup, media, mixing, packing, queries, suffixdedup, tokens

from ..conftest import SF, same
from . import brute
from .conftest import LONG, PASSAGE, ROWS


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


# 1: media


def test_media_round_trip(spark, odd, empty):
    got = defaultdict(list)
    for r in media.media_features(odd).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(ROWS) and media.media_features(empty).count() == 0
    for doc, text, *_ in ROWS:
        raw = (text or "").encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = next(x for x in got[doc] if x["n_bytes"] == len(raw))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.encode_jpeg(p)).hexdigest()
        assert r["feature"] == brute.media_feature(p, r["width"], r["height"]) and r["width"] * r["height"] >= len(p)
    assert got[1][0]["feature"] == got[2][0]["feature"] != got[7][0]["feature"]


def test_jpeg_decoder_general_path():
    rng = np.random.default_rng(0)
    p = rng.integers(0, 256, 64 * 40, np.uint8).tobytes()
    data = media.encode_jpeg(p)
    image, c = media.decode_jpeg(data)
    assert media.payload_of(image, c) == p
    h = image["huff"]
    assert (np.array(media._general([image["scan"]], image, [(0, h[0], h[0x10])], len(c))[0]) == c).all()
    assert media.thumbnail(image, c).reshape(-1)[:40].tobytes() == p[::64]
    with pytest.raises(ValueError):
        media._general([image["scan"][:200]], image, [(0, h[0], h[0x10])], len(c))
    with pytest.raises(ValueError):
        media.decode_jpeg(b"no image")


@pytest.mark.parametrize(("width", "height", "restart"), [(40, 24, 2), (16, 8, 0), (33, 9, 1), (200, 64, 3)])
def test_jpeg_of_another_coder(width, height, restart):
    data, first, step = brute.colour_jpeg(width, height, 5, restart)
    image, c = media.decode_jpeg(data)
    assert (c == np.array(first)).all() and (image["width"], image["height"]) == (width, height)
    got = media.thumbnail(image, c)
    across, down = -(-width // 8), -(-height // 8)
    assert got.shape == (down, across)  # no blocks that only fill the last units
    for y in range(down):
        for x in range(across):
            dc = first[2 * (y * -(-width // 16) + x // 2) + x % 2][0]
            assert got[y, x] == min(max(round(float(dc) * step / 8 + 128), 0), 255)


def test_media_query(spark):
    assert queries.op1_media_columns(spark, SF).count() == len(documents())


# 2: token counts


def test_token_counts(spark, odd, empty):
    encode = tokens.encoder(queries.bpe_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    lengths = np.array([len(encode(t)) for t in [*documents()["text"], *(r[1] or "" for r in ROWS)]])
    sums = tokens.suffix_sums(tokens.length_histogram(docs, queries.bpe_path())).cache()
    for r in sums.collect():
        n = r["n_tokens"]
        assert (r["n_docs"], r["docs_longer"], r["docs_within"]) == ((lengths == n).sum(), (lengths > n).sum(), (lengths <= n).sum())
        assert (r["total_tokens"], r["truncated_tokens"]) == (lengths.sum(), np.minimum(lengths, n).sum())
    for r in tokens.at_limits(sums, [0, 7, 512, 513, 2048, 10**6]).collect():
        c = r["context_limit"]
        assert (r["docs_longer"], r["truncated_tokens"]) == ((lengths > c).sum(), np.minimum(lengths, c).sum())
    for r in tokens.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == np.sort(lengths)[int(np.ceil(r["q"] * len(lengths))) - 1]
    assert tokens.suffix_sums(tokens.length_histogram(empty, queries.bpe_path())).count() == 0


def test_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    exact, encode = Tokenizer.from_file(queries.bpe_path()), tokens.encoder(queries.bpe_path())
    for t in ["", "a<|endoftext|>b", " " * 200_000, "x" * 50_000, "  \n\n é ß 漢字 🎉 it's 1234", *documents()["text"][:50]]:
        assert list(encode(t)) == exact.encode(t, add_special_tokens=False).ids


# 3: language identification


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    far = got[got["held_out"] & (got["lang_pred"] != "und")]
    assert (far["lang_pred"] == far["lang"]).mean() > 0.95
    assert (far["family_pred"] == far["lang"].map(langid.family_of)).mean() > 0.95


def test_language_id_odd_rows(spark, odd, empty):
    model = langid.fit(odd)
    got = langid.identify(odd, model, keep=True).collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
        assert r["row"]["lang_pred"] == "x" and r["row"]["a.b"] == "x"
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    one = langid.fit(odd.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.identify(odd, one).collect()} == {"und", "en"}


# 4: line dedup


def test_line_dedup_matches_duckdb(spark, duck):
    same(queries.op4_line_dedup(spark, SF), duck, queries.oracle_sql()["op4_line_dedup"])


def test_line_dedup_of_planted_runs(spark):
    a, b, c = "the first line of a run", "and its second line here", "something else entirely now"
    rows = [(1, f"{a}\n{b}\n{c} 1"), (2, f"x {c}\n{a}\n{b}\nown line of the second text"), (3, f"{b}\n{b}\n{b}"), (4, "x\ny\n\n" * 8 + "z"), (5, "x\ny\n\n" * 8 + "w"), (6, "short"), (7, "short")]
    got = {r["doc_id"]: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1]
    assert got[2]["text"] == f"x {c}\nown line of the second text" and got[2]["n_spans"] == 1
    assert got[3]["n_removed"] == 3 and got[3]["text"] == ""
    assert got[5]["text"] == "w" and got[6]["text"] == got[7]["text"] == "short"


def test_line_dedup_odd_rows(odd, empty):
    got = linededup.dedup(odd).collect()
    assert len(got) == len(ROWS) and linededup.dedup(empty).count() == 0
    by = {(r["doc_id"], r["n_lines"]): r for r in got}
    assert by[(2, 2)]["n_removed"] == 2 and by[(1, 2)]["n_removed"] == 0 and by[(3, 0)]["text"] is None
    assert [r["n_removed"] for r in got if r["text"] == "one"] == [0, 0]
    kept = linededup.kept_documents(odd)
    assert kept.columns == odd.columns and 2 not in {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("places", [2, 1 << 13])
def test_line_dedup_by_the_suffix_array(spark, monkeypatch, places):
    """Places, common prefixes and intervals against sorted suffixes; small ranges of places hand their last class and open interval on."""
    monkeypatch.setattr(linededup, "PLACES", places)
    rng = np.random.default_rng(4)
    docs = [[str(rng.choice(["a", "bb", "", "a long line that is common", "own"])) for _ in range(rng.integers(1, 30))] for _ in range(25)]
    docs = [[f"own {i} {j}" if x == "own" else x for j, x in enumerate(d)] for i, d in enumerate(docs)] + [["a", "bb"] * 14, [""] * 30] * 2
    df = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    suffixes = linededup._ranked(linededup._lines(df, 20)).cache()
    rows = {(r["doc"]["doc_id"], r["pos"]): r for r in suffixes.collect()}
    depth = max(r["need"] or 1 for r in rows.values())
    assert depth == 21
    lines = {(i, j): [rows[i, j + x]["line"] for x in range(r["reach"])] for (i, j), r in rows.items()}
    assert all((i, j + r["reach"]) not in rows for (i, j), r in rows.items())
    array = linededup.suffix_array(suffixes, depth)
    order = sorted((r["rank"], r["doc"]["doc_id"], r["pos"]) for r in array.collect())
    assert [lines[at[1:]][:depth] for at in order] == sorted(x[:depth] for x in lines.values())
    assert all(rank == next(i for i, x in enumerate(order) if x[0] == rank) for rank, *_ in order)

    def shared(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    lcps = linededup.lcp_array(array, depth)
    found, before = sorted(lcps.collect(), key=lambda r: r["rank"]), []
    assert len({r["bucket"] for r in found}) > 20 or places > 2
    for r in found:
        own = lines[r["first"]["doc"]["doc_id"], r["first"]["pos"]][: r["need"]]
        assert r["lcp"] == shared(before, own)
        before = own
    want = defaultdict(set)
    for at, r in rows.items():
        if r["need"]:
            want[tuple(lines[at][: r["need"]])].add(at)
    got, sizes = defaultdict(set), Counter()
    members = defaultdict(set)
    for rank, *at in order:
        members[rank].add(tuple(at))
    for r in linededup.lcp_intervals(lcps).collect():
        got[r["interval"]] |= members[r["rank"]]
        sizes[r["interval"]] += r["n"]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and all(len(got[k]) == n for k, n in sizes.items())
    late = {x for s in want.values() for at in sorted(s)[1:] for x in ((at[0], at[1] + i) for i in range(rows[at]["need"]))}
    runs = {r["doc"]["doc_id"]: r["runs"] for r in linededup.later_copies(df).collect()}
    assert {(i, j) for i, x in runs.items() for a, b in x for j in range(a, b)} == late and late


# 5: licence scans


def test_license_scan(spark, duck, odd, empty):
    same(queries.op5_license_scan(spark, SF), duck, queries.oracle_sql()["op5_license_scan"])
    assert licenses.scan(odd).count() == len(ROWS) and licenses.scan(empty).count() == 0
    s = licenses.SENTENCES
    rows = [
        (1, "Head. " + ".\n".join(s[k] for k in "hij") + ".\nCode follows."),
        (2, f"{s['t']}\n * {s['u']}.\n * {s['v']}.\n * {s['w']}."),
        (3, f"{s['t']}\n 1. {s['u']}.\n 2. {s['v']}.\nNothing else."),
        (4, f"{s['s']}. {s['o']}. {s['s'].upper()}!"),
        (5, f"{s['i']}."),
        (6, f"{s['x']}. {s['h']}"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["licenses"] == "MIT" and got[1]["n_matches"] == 1
    assert got[2]["licenses"] == "BSD-3-Clause" and got[3]["licenses"] == "BSD-2-Clause"
    assert got[4]["licenses"] == "CC-BY-NC-4.0 AND Proprietary" and got[4]["n_matches"] == 3
    assert got[5]["licenses"] is None and got[5]["known_sentences"] == 1
    assert got[6]["licenses"] == "MIT AND MPL-2.0"


def test_whole_licences_as_they_are_wrapped(spark):
    """Hard-wrapped texts, plain, behind comment marks and with numbered clauses."""
    import textwrap

    s = licenses.SENTENCES
    mit = [s["h"], s["i"] + ".", s["j"] + ". " + s["A"] + "."]
    bsd = [s["t"], "1. " + s["u"] + ".", "2. " + s["v"] + ".", "3. " + s["w"] + ".", s["B"] + ". " + s["C"] + "."]
    apache = [s["b"] + ". " + s["c"], s["d"] + ". " + s["e"] + "."]
    gpl = [s["l"] + ".", s["m"] + ". " + s["n"] + "."]

    def text(parts, mark="", head="Copyright (c) 2020 Someone"):
        lines = "\n\n".join("\n".join(textwrap.wrap(p, 70)) for p in [head, *parts]).split("\n")
        return "\n".join((mark + x).rstrip() for x in lines)

    rows = [
        (1, text(mit), "MIT"), (2, text(bsd), "BSD-3-Clause"), (3, text(bsd[:3] + bsd[4:]), "BSD-2-Clause"), (4, text(apache, "# "), "Apache-2.0"),
        (5, text(gpl, " * "), "GPL-3.0-or-later"), (6, text(mit, "// "), "MIT"), (7, "// SPDX-License-Identifier: BSL-1.0\nint main();", "BSL-1.0"),
        (8, "    GNU GENERAL PUBLIC LICENSE\n       Version 2, June 1991\n\nCopyright", "GPL-2.0-only"), (9, text([s["D"] + "."]), "ISC"), (10, "Ein Haus mit Garten. mit", None),
        (11, "", None), (12, None, None),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {k: r["licenses"] for k, r in got.items()} == {r[0]: r[2] for r in rows}
    assert all(got[k]["n_matches"] == 1 for k in range(1, 10))


# 6: nearest neighbours


def _nearest(ids, v, every, k):
    s = v @ v.T
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        order = [j for j in np.lexsort((ids, -s[i])) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), s[i, j]) for j in order]
    return out


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0]), (None, [1.0, 1.0]), (11, [-1.0, 0.5]), (40, [0.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))).collect()
    near = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        near[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(near) == {0: [(3, 1.0), (4, 1.0), (20, 0.0), (11, -1.0)], 20: [(11, 1.0), (0, 0.0), (3, 0.0), (4, 0.0)]}
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0, 0.0]), (20, [1.0, 3.0]), (2, [4.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in ann.search(two).collect()) == [(0, 1, 2, 4.0), (20, 1, 1, 2.0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_a_common_vector(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((600, 8))
    v[::3] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    want = _nearest(np.arange(600), v, 20, 20)
    for q, part in got.sort_values("rank").groupby("query_id"):
        assert [x for x, _ in want[q]] == part["vec_id"].tolist()
        assert np.allclose([s for _, s in want[q]], part["score"], rtol=1e-12)
    assert got["query_id"].nunique() == 30


def test_pruned_search_recall(spark):
    """Vectors with structure, a queue that opens less than half of them: far leaves stay shut, and recall holds."""
    rng = np.random.default_rng(6)
    centres = 4 * rng.standard_normal((40, 16))
    v = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), share=0.6, least=50).toPandas()
    want = _nearest(np.arange(4000), v, 20, 20)
    hits = sum(len({x for x, _ in want[q]} & set(part["vec_id"])) for q, part in got.groupby("query_id"))
    assert 0.9 <= hits / (20 * len(want)) and got.groupby("query_id").size().eq(20).all()
    forest = ann.Forest.fit(v, ann.TREES, 5)
    leaf = forest.leaves(v)
    sizes = np.stack([np.bincount(leaf[:, t], minlength=32) for t in range(ann.TREES)])
    seen = [np.any([leaf[:, k // 32] == k % 32 for k in ann.opened(forest.costs(v[q]), sizes, 2400)], axis=0).mean() for q in range(0, 4000, 400)]
    assert max(seen) < 0.5


def test_forest_recall():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.Forest.fit(x[:8000], ann.TREES, 6)
    leaf = forest.leaves(x)
    sizes = np.stack([np.bincount(leaf[:, t], minlength=64) for t in range(ann.TREES)])
    hits = 0
    for q in range(0, 20_000, 500):
        mask = np.zeros(len(x), bool)
        for key in ann.opened(forest.costs(x[q]), sizes, int(ann.SHARE * len(x))):
            mask |= leaf[:, key // 64] == key % 64
        s = x @ x[q]
        s[q] = -9
        hits += mask[np.argsort(-s)[:20]].sum()
    assert hits / (40 * 20) >= 0.9


# 7: packing


def _check_packing(got, docs, size=2048):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(queries.bpe_path())
    by = Counter()
    for r in got:
        by[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    want = Counter()
    for doc, text in docs:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        edges = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert by == want
    fill = defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(fill), -(-sum(r["length"] for r in got) // size)


def test_packing(spark, odd, empty):
    d = documents()
    n, least = _check_packing(queries.op7_best_fit_packing(spark, SF).collect(), list(zip(d["doc_id"].tolist(), d["text"])))
    assert n <= least + 2
    _check_packing(packing.pack(odd, queries.bpe_path()).collect(), [(r[0], r[1]) for r in ROWS])
    assert packing.pack(empty, queries.bpe_path()).count() == 0


def test_packing_plans_are_gapless_and_tight():
    rng = np.random.default_rng(0)
    for _ in range(100):
        size = int(rng.integers(1, 40))
        counts = rng.integers(0, 6, size + 1) * (rng.random(size + 1) < 0.6)
        counts[0] = 0
        segments, n = packing.plan(counts)
        items = sorted((s + k, o, length) for length, lo, hi, s, o in segments for k in range(hi - lo))
        ends = defaultdict(int)
        for s, o, length in items:
            assert o == ends[s]
            ends[s] += length
        assert len(ends) == n and max(ends.values(), default=0) <= size
        assert Counter(x for *_, x in items) == Counter({k: int(v) for k, v in enumerate(counts) if v})


# 8: suffix-array dedup


def _check_repeats(got, rows):
    raws = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (doc, _), raw, gone in zip(rows, raws, brute.repeats(raws)):
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[(doc, len(raw), sum(gone), brute.spans(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want


def test_suffix_dedup(spark, odd, empty):
    d = documents()
    _check_repeats(queries.op8_suffix_array_dedup(spark, SF).collect(), list(zip(d["doc_id"].tolist(), d["text"])))
    assert suffixdedup.repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [5000, 2])
def test_suffix_dedup_odd_rows(spark, odd, monkeypatch, hot):
    """Null and empty texts, ids that are null or repeat, texts above a step, columns of clashing names."""
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    got = suffixdedup.repeats(odd).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((doc, len((t or "").encode())) for doc, t, *_ in ROWS)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    n = len(LONG)
    assert n > suffixdedup.STEP
    empty_sha = hashlib.sha256(b"").hexdigest()
    assert tuple(by[7][0])[2:] == (n, 1, empty_sha) and tuple(by[8][0])[2:] == (n, 1, hashlib.sha256(b" tail").hexdigest())
    for doc in (1, 2, 3, 4, 5, 6, 11, None):
        assert all(r["n_removed"] == r["n_spans"] == 0 for r in by[doc])
    assert by[9][0]["n_removed"] == by[10][0]["n_removed"] == len((PASSAGE + " ").encode()) - 1 and by[9][0]["n_spans"] == 1
    repeated = [(20, LONG[: suffixdedup.STEP + 1000]), (20, LONG[: suffixdedup.STEP + 1000]), (21, "a" * 1000)]
    same_ = {r["doc_id"]: r for r in suffixdedup.repeats(spark.createDataFrame(repeated, "doc_id long, text string")).collect()}
    assert same_[20]["n_removed"] == suffixdedup.STEP + 1000 and same_[21]["n_removed"] == 1000


@pytest.mark.parametrize("hot", [5000, 2, 3])
def test_suffix_dedup_of_planted_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    rng = np.random.default_rng(9)

    def text(n):
        return "".join(rng.choice(list("abcdé fgh"), n))

    p399, p400, p900 = "q" + text(395), "r" + text(410), text(900)
    rows = [(1, text(500) + p400 + text(30)), (2, p400), (3, text(50) + p399[:390] + text(600)), (4, p399[:390]), (5, p900 + text(9) + p900), (6, text(700) + p900[100:700]), (7, "ab" * 700), (8, "z" * 450), (9, "z" * 399), (None, p900), (10, p900), (10, p900)]
    got = suffixdedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    _check_repeats(got, rows)


def test_loser_tree_never_loses_a_prefix():
    rng = np.random.default_rng(1)
    for _ in range(100):
        runs, every = [], []
        for _ in range(rng.integers(0, 6)):
            v = sorted({bytes(rng.choice([97, 98], rng.integers(1, 9)).tolist()) for _ in range(8)})
            every += v
            runs.append(suffixdedup.Run(*suffixdedup.front_code(v)))
        got = list(suffixdedup.merge(runs))
        assert [g[3] for g in got] == sorted(every)
        assert all(b[2] == suffixdedup.shared_prefix(a[3], b[3]) for a, b in zip(got, got[1:]))


# 9: mixing


def _targets(sizes):
    weigh = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, pool, out = dict(sizes), 1.5 * sum(sizes.values()), {}
    while left:
        total = sum(weigh[s] for s in left)
        full = [s for s in left if pool * weigh[s] / total > 2 * sizes[s]]
        if not full:
            return out | {s: pool * weigh[s] / total for s in left}
        for s in full:
            out[s] = 2.0 * sizes[s]
            del left[s]
        pool = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def _check_mix(got, rows):
    sizes, targets_, taken = Counter(), {}, Counter()
    for _, t, source in rows:
        sizes[source] += len(brute.words(t))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(brute.words(t))) for d, t, _ in rows)
    for r in got:
        targets_[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
    want = _targets(dict(sizes))
    for s, t in want.items():
        assert targets_[s] == pytest.approx(t, rel=1e-9) and abs(taken[s] - t) <= 8


def test_mixing(spark, odd, empty):
    d = documents()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs, shard_docs=15)
    _check_mix(got.collect(), list(zip(d["doc_id"], d["text"], d["source"])))
    again = mixing.mix(docs.repartition(7), shard_docs=15)
    assert sorted(map(str, got.drop("runs").collect())) == sorted(map(str, again.drop("runs").collect()))
    _check_mix(mixing.mix(odd).collect(), [(r[0], r[1], r[3]) for r in ROWS])
    assert mixing.mix(empty).count() == 0


def test_mixed_documents_hold_the_words_taken(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(mixing.words(F.col("text")))).first()[0] == taken
    assert mixing.mixed(odd).columns == odd.columns


def test_sainte_lague_is_the_highest_quotients(spark):
    rng = np.random.default_rng(6)
    for seats in (0, 1, 17, 400):
        w = np.concatenate([rng.integers(1, 30, 40), [5000, 0]])
        df = spark.createDataFrame([(i, int(x), seats) for i, x in enumerate(w)], "p long, w long, seats long")
        got = {r["p"]: r["quota"] for r in mixing.sainte_lague(df, [], ["p"], "w", "seats").collect()}
        quotients = sorted(((-x / (2 * k + 1), k, i) for i, x in enumerate(w) for k in range(seats) if x), key=lambda q: q)[:seats]
        want = Counter(i for _, _, i in quotients)
        assert sum(got.values()) == seats
        lowest = min((w[i] / (2 * got[i] - 1) for i in got if got[i]), default=np.inf)
        highest = max((w[i] / (2 * got[i] + 1) for i in got), default=0)
        assert seats == 0 or lowest >= highest - 1e-12 or want == got


# 10: Jaccard join


def _check_join(got, rows):
    sets = [brute.shingles(t) for _, t in rows]
    root = brute.components(sets)
    ids = defaultdict(list)
    for (doc, _), r in zip(rows, root):
        ids[r].append(doc)
    want = Counter()
    for (doc, _), s, r in zip(rows, sets, root):
        known = [i for i in ids[r] if i is not None]
        want[(doc, len(s), (min(known) if known else None) if s else doc)] += 1
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("chunk", [1024, 8])
def test_jaccard_join(spark, odd, empty, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    d = documents()
    _check_join(jaccard.join(spark.read.parquet(f"{SF}/documents.parquet")).collect(), list(zip(d["doc_id"].tolist(), d["text"])))
    _check_join(jaccard.join(odd).collect(), [(r[0], r[1]) for r in ROWS])
    assert jaccard.join(empty).count() == 0


@pytest.mark.parametrize("chunk", [1024, 64])
def test_jaccard_join_of_many_near_copies(spark, monkeypatch, chunk):
    """One region of alike distances: split, replicated and joined in blocks, without putting out all links."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    folded, counts = jaccard._components, []
    monkeypatch.setattr(jaccard, "_components", lambda links: (counts.append(links.count()), folded(links))[1])
    rng, rows = np.random.default_rng(3), []
    for n in range(400):
        w = [f"w{i}" for i in range(60)]
        for i in rng.integers(0, 60, rng.integers(1, 4)):
            w[i] = f"n{rng.integers(10**9)}"
        rows.append((n, " ".join(w)))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    _check_join(got, rows)
    size = Counter(r["component_id"] for r in got)
    assert counts[-1] <= 12 * sum(n for n in size.values() if n > 1)


def test_regions_join_and_deal_exactly():
    rng = np.random.default_rng(5)
    for _ in range(60):
        base = rng.integers(0, 60, 30)
        sets = [np.unique(np.concatenate([base[rng.random(30) < 0.9], rng.integers(0, 10**6, rng.integers(0, 5))])).astype(np.uint64) for _ in range(12)]
        close = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets]
        for links in (jaccard.join_region(sets), jaccard.deal(sets, 12)[1]):
            up = jaccard._Union(12)
            for a, b in links:
                assert close[a][b] >= 0.75 and up.join(a, b)
            assert all(up.find(a) == up.find(b) for a in range(12) for b in range(12) if close[a][b] >= 0.75)
        assert np.allclose(jaccard.deal(sets, 5)[0], 1 - np.array(close)[:, :5])


def test_jaccard_join_of_graded_copies(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for size in (6, 9, 40, 300):
        base = [f"w{x}" for x in rng.integers(0, 10**6, size)]
        for changes in (0, 0, 1, 2, 3, 5, 8):
            w = list(base)
            for i in rng.integers(0, size, changes):
                w[i] = f"new{rng.integers(10**6)}"
            rows.append((n, " ".join(w).upper() if changes == 1 else " ".join(w)))
            n += 1
    _check_join(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_jaccard_join_sends_no_sets_that_share_too_little(spark, monkeypatch):
    """Each text shares a passage and many phrases with others, all in all too little: none is sent to a region."""
    members, sent = jaccard._members, []
    monkeypatch.setattr(jaccard, "_members", lambda docs, want: (sent.append(want.count()), members(docs, want))[1])
    word = lambda *at: " ".join(f"w{x}" for x in at)
    rows = []
    for n in range(60):
        phrases = [word(*(f"{k}p{(n + k * side) % 60}p{j}" for j in range(5))) for k in range(1, 21) for side in (0, 1)]
        passage = word(*(f"{n // 2}s{j}" for j in range(40)))
        rows.append((n, " ".join([passage, *(f"{x} {word(*(f'{n}r{i}r{j}' for j in range(9)))}" for i, x in enumerate(phrases))])))
    _check_join(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    assert sent == [0]


def test_jaccard_join_of_classes_with_one_short_name(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 1)
    rng, rows = np.random.default_rng(4), []
    for n in range(300):
        w = [f"w{n // 3}x{i}" for i in range(40)]
        w[rng.integers(0, 40)] = f"n{n}"
        rows.append((n, " ".join(w)))
    _check_join(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_jaccard_join_sends_texts_that_are_wanted(spark):
    docs = spark.range(20_000).selectExpr("IF(id = 7, NULL, id) AS doc_id", "'x' AS text")
    want = spark.range(300).selectExpr("IF(id = 7, NULL, id * 10) AS doc_id")
    found = [r["doc_id"] for r in jaccard._sieved(docs, want).collect()]
    assert {r["doc_id"] for r in want.collect()} <= set(found) and len(found) < 1000


def test_stored_tables_leave_no_shuffle_files(spark):
    """The shuffles that made a table go with its write, whatever the driver's heap; the session's setting stays."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if x.endswith(".data")}
    before, kept = files(), spark.conf.get(common.CLEANUP, None)
    table = common.stored(spark.range(10_000).selectExpr("id % 100 AS k").repartition(4, "k").groupBy("k").count(), "counts")
    deadline = time.time() + 10
    while (left := files() - before) and time.time() < deadline:
        time.sleep(0.1)
    assert not left and spark.conf.get(common.CLEANUP, None) == kept
    assert table.count() == 100 and table.agg(F.sum("count")).first()[0] == 10_000


def test_one_of_each(spark, odd):
    kept = jaccard.one_of_each(odd)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == odd.columns
    want = [(r[0], r[1]) for r in ROWS if r[0] not in (2, 8, 10)]
    want.remove((12, "one"))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_texts_hash_like_short_ones():
    raw = (LONG + " ") .encode() * 8
    whole = jaccard._combined(jaccard._long_text(jaccard._LOWER[np.frombuffer(raw, np.uint8)]), 5)
    starts, w = jaccard._words(jaccard._LOWER[np.frombuffer(raw, np.uint8)])
    assert (np.unique(whole) == np.unique(jaccard._combined(w, 5))).all()
