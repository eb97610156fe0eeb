"""Packages of web archives, the divergence audit and fill-in-middle, each against a plain version."""

import gzip
import hashlib
import io
import itertools
import json
import re
import zipfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortscore.llm import divergence, fim, queries, warc

from ..conftest import SF, same
from .conftest import CLASHES, LONG, ROWS

# 11: archives


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("sha1", "lead", "path", "offset", "payload", "a.b")}).repartition(3)


BIG = "<p>" + "größer " * 400
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2 with blank", BIG), (9, None, BIG), (3, "http://a/3", "x" * 999), (4, "http://a/4", "x" * 999), (5, "", None), (6, "http://a/6", ""),
    (7, "http://b/7", "y" * 1000), (8, "http://b/8", "y" * 1000), (None, "http://b/0", "y" * 1000), (10, "http://c", LONG * 20), (11, "http://d", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n" * 60),
    (12, "http://e", "z" * 1500), (12, "http://e", "z" * 1500), (13, "http://f\r\nWARC-Type: bad", "q"),
]


def _brute_pages(rows, least=1000):
    lead = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least and page is not None:
            lead[raw] = max(lead.get(raw, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        best = lead.get(raw)
        revisit = best is not None and page != best
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return Counter(out)


def test_warc_round_trip(spark):
    pages = _pages(spark, PAGES)
    got = warc.roundtrip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == _brute_pages(PAGES)
    assert warc.roundtrip(pages.limit(0)).count() == 0


def test_warc_query(spark, duck):
    same(queries.op11_warc(spark, SF), duck, queries.oracle_sql()["op11_warc"])


def test_packages_are_zip_files_that_others_read(spark, tmp_path):
    told = warc.archive(_pages(spark, PAGES), str(tmp_path / "all")).collect()
    assert sum(r["n_records"] for r in told) == len(PAGES)
    found = []
    for r in told:
        with zipfile.ZipFile(r["path"]) as z:
            assert z.testzip() is None and sorted(z.namelist()) == [warc.DATA, warc.INDEX] and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            data, lines = z.read(warc.DATA), z.read(warc.INDEX).splitlines()
            assert lines == sorted(lines) and len(lines) == r["n_records"]
            for line in lines:
                at = json.loads(line[line.index(b"{") :])
                found.append(warc.parsed(gzip.decompress(data[int(at["offset"]) : int(at["offset"]) + int(at["length"])])))
            assert gzip.decompress(data).count(b"WARC-Record-ID") == len(lines)
    payloads = {x["id"]: x["payload"] for x in found if x["type"] == "response"}
    for page, _, html in PAGES:
        if (urn := warc._urn(page)) in payloads:
            assert payloads[urn].decode() == (html or "")
    assert all(x["payload"] is None and x["refers_to"] in payloads for x in found if x["type"] == "revisit")
    assert not any("\n" in x["url"] for x in found)


def _ranges(data):
    class File:
        def read_at(self, n, at):
            return data[at : at + n]

    return warc.Ranges(File(), len(data))


@pytest.mark.parametrize("limit", [None, 10])
def test_members_of_packages_by_another_writer(monkeypatch, limit):
    if limit:  # every size and place in ZIP64 fields
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    out = io.BytesIO(b"")
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"a comment with PK\5\6 in it"
        for i in range(40):
            z.writestr(f"archive/{i}.warc", f"body {i} ".encode() * i, zipfile.ZIP_DEFLATED if i == 7 else zipfile.ZIP_STORED)
    data = out.getvalue()
    assert (warc.LOCATOR in data) == bool(limit)
    for block in (1 << 20, 60):
        got = list(warc.members(_ranges(data), block))
        assert [m.name for m in got] == [f"archive/{i}.warc" for i in range(40)] and [m.method for m in got] == [8 if i == 7 else 0 for i in range(40)]
        for i, m in enumerate(got):
            if i != 7:
                assert data[m.start : m.start + m.size] == f"body {i} ".encode() * i


def test_directory_of_more_entries_than_sixteen_bits_count():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):
            z.writestr(str(i), b"")
    got = warc.members(_ranges(out.getvalue()))
    assert sum(1 for _ in got) == 66_000


@pytest.mark.parametrize("data", [b"", b"PK", b"PK\5\6" + b"\0" * 17, b"x" * 100])
def test_broken_packages_raise(data):
    with pytest.raises(ValueError):
        list(warc.members(_ranges(data)))
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("a", b"b" * 100)
    with pytest.raises(ValueError):
        list(warc.members(_ranges(whole.getvalue()[60:])))


def test_foreign_packages(spark, tmp_path):
    """A package of two archives, a gzipped index, records not in the index's order; a deflated archive raises."""
    records = [[warc.record(f"urn:page:{10 * k + i}", f"http://{i}", b"p" * i, i, hashlib.sha1(b"p" * i).hexdigest(), None) for i in range(5)] for k in (0, 1)]
    for method, name in ((zipfile.ZIP_STORED, "good"), (zipfile.ZIP_DEFLATED, "bad")):
        with zipfile.ZipFile(tmp_path / f"{name}.wacz", "w") as z:
            lines = []
            for k, group in enumerate(records):
                at, body = 0, b""
                for r in group:
                    data = gzip.compress(r)
                    lines.append(f"u 0 {json.dumps({'filename': f'{k}.warc.gz', 'offset': at, 'length': len(data)})}\n")
                    body, at = body + data, at + len(data)
                z.writestr(f"archive/{k}.warc.gz", body, method)
            z.writestr("indexes/index.cdxj.gz", gzip.compress("".join(reversed(lines)).encode()), zipfile.ZIP_STORED)
            z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
    paths = lambda name: spark.createDataFrame([(str(tmp_path / f"{name}.wacz"), 10)], "path string, n_records long")
    ranges = warc.locate(paths("good"), most=100)
    assert ranges.count() == 10 and warc.locate(paths("good")).count() == 2
    got = sorted(warc.read_records(ranges).select("record_id", "payload_bytes", "payload").collect())
    assert [(r["record_id"], bytes(r["payload"])) for r in got] == sorted((f"urn:page:{10 * k + i}", b"p" * i) for k in (0, 1) for i in range(5))
    with pytest.raises(Exception, match="deflated"):
        warc.locate(paths("bad")).collect()


def test_cut_and_changed_records_raise():
    raw = warc.record("urn:page:1", "http://a", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parsed(raw)["payload"] == b"abc"
    for bad in (raw[:-5], raw.replace(b"abc", b"abd"), b"no record" + raw):
        with pytest.raises(ValueError):
            warc.parsed(bad)


# 12: divergence


def _brute_audit(rows, least, top):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    df, n, groups = Counter(), defaultdict(Counter), {(lang, source) for lang, source, _ in docs}
    for lang, source, terms in docs:
        df.update({(lang, t) for t in terms})
        n[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), c in df.items() if x == lang and c >= least]
        sources = sorted(s for x, s in groups if x == lang)
        counts = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        counts[None] = {t: sum(counts[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 5) // (sum(own.values()) + 5 * len(kept)) for t, c in own.items()} for s, own in counts.items()}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((p[None][t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > p[None][t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def _audited(df, **more):
    return sorted(map(tuple, divergence.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_divergence_query(spark, duck):
    same(queries.op12_source_divergence(spark, SF), duck, queries.oracle_sql()["op12_source_divergence"])


@pytest.mark.parametrize(("least", "chunk"), [(1, 1 << 20), (2, 300), (50, 300)])
def test_divergence_odd_rows(odd, empty, least, chunk):
    rows = [(r[1], r[2], r[3]) for r in ROWS]
    assert _audited(odd, least=least, chunk=chunk) == _brute_audit(rows, least, 50)
    assert divergence.audit(empty).count() == 0


def test_divergence_of_many_sources(spark, monkeypatch):
    """Sources over several tiles, words over several blocks, groups without words, ties and code points above ASCII."""
    monkeypatch.setattr(divergence, "TILE", 4)
    vocabulary = ["Alpha", "beta", "ÄÖ", "gamma-delta", "x1y", "ÉTÉ été", "漢字", " nb", "epsilon", "Zeta"]
    rows = []
    for i in range(400):
        words = [vocabulary[(i * k + k * k) % len(vocabulary)] for k in range(i % 9)]
        rows.append((" ".join(words) if i % 17 else None, ["en", "de", None][i % 3], f"s{i % 11}" if i % 13 else None))
    rows += [("", "fr", "only"), ("alpha " * 40, "it", "a"), (".", "it", "b"), ("...", "it", "ä")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    want = _brute_audit(rows, 20, 3)
    prepared = divergence.prepare(df, 400, 100)
    kept = divergence.kept_terms(prepared, 20)
    counts = divergence.occurrences(prepared, kept, held=7, shared=2)
    groups = prepared.where("body is not null").select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0)
    got = sorted(map(tuple, divergence.pair_distances(counts, groups, tile=4, block=20).collect()))
    assert got == sorted((lang, s, item, v) for lang, s, part, item, v, _ in want if part == "pair")
    assert _audited(df, least=20, top=3, chunk=500) == want


def test_shares_are_exact_beyond_doubles(spark):
    n, total, v = 987_654_321_987, 9_999_999_999_999, 123_456_789
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("z")).first()
    assert got["p"] == 1 + 10**9 * (n + 5) // (total + 5 * v) and got["z"] == 0


# 13: fill-in-middle


def _brute_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middle_query(spark, duck):
    same(queries.op13_fill_in_middle(spark, SF), duck, queries.oracle_sql()["op13_fill_in_middle"])


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 16])
def test_cuts_by_chunks(chunk):
    texts = ["", "a", "ab cd", "aä bß漢c", "漢字" * 9, "<P", "<<P<S<M", "a<S>b", "x" * 50, " \r\n\t", "Ab1Cd2", "\U0001f600a\U0001f600", "don't <stop> now"]
    for i, text in itertools.product(range(60), texts):
        out, n, form, prefix, middle = fim.moved(text.encode(), i, chunk=chunk)
        assert (n, form, prefix, middle, out.decode()) == _brute_fim(i, text)


def test_middles_of_odd_rows(spark, odd, empty):
    more = spark.createDataFrame([(i, "a<" * (i % 5) + " <M" + "> rest " * (i % 3), None, None, None) for i in range(100, 160)], "doc_id long, text string, lang string, source string, n_chars long")
    df = odd.unionByName(more, allowMissingColumns=True)
    got = fim.transform(df).withColumn("back", fim.restored(F.col("fim_text"), F.col("fim_form"))).collect()
    assert len(got) == len(ROWS) + 60 and fim.transform(empty).count() == 0
    for r in got:
        assert (r["n_tokens"], r["fim_form"], r["prefix_chars"], r["middle_chars"], r["fim_text"]) == _brute_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["fim_form"] for r in got} == {"plain", "psm", "spm"}
    assert set(df.columns) <= set(got[0].asDict()) and all(c in got[0].asDict() for c in CLASHES)
    digests = {r["doc_id"]: r for r in fim.digests(more).collect()}
    assert all(r["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in map(tuple, more.collect()) for r in [digests[i]])
