"""SentencePiece, decontamination, WARC and URL filter."""

import struct
from html.parser import HTMLParser

import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from quillstream.llm import decontamination as dec
from quillstream.llm import sentencepiece_codec as spc
from quillstream.llm import url_filter, warc
from quillstream.llm.common import read_table


def test_encoding_has_parity_on_whole_texts(spark, sf_dir, odd, empty):
    reference = sentencepiece.SentencePieceProcessor(model_file=spc.DEFAULT_MODEL)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    for given in (docs, odd.select("doc_id", "text")):
        texts = {(r.doc_id, r.text) for r in given.collect()}
        got = spc.encode(given, verify=True).collect()
        assert len(got) == given.count() and all(r.parity for r in got)
        want = {(i, tuple(reference.encode(t or ""))) for i, t in texts}
        assert {(r.doc_id, tuple(r.ids)) for r in got} == want
        back = {(r.doc_id, r.text) for r in spc.decode(spc.encode(given)).collect()}
        assert back == {(i, (t or "").replace("▁", " ")) for i, t in texts}
    assert spc.encoding_digests(empty).collect() == []
    assert {r.doc_id: r.decoded_equal for r in spc.encoding_digests(odd).collect()}[7] is False


def message(*fields):
    out = b""
    for number, kind, value in fields:
        out += bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
        out += value if kind == 5 else bytes([len(value)]) + value if kind == 2 else bytes([value])
    return out


def test_a_unigram_model_with_byte_fallback():
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    pieces += [("▁ab", -1.0, 1), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -2.5, 1), ("abab", -6.0, 1)]
    data = b"".join(message((1, 2, message((1, 2, p.encode()), (2, 5, struct.pack("<f", s)), (3, 0, k)))) for p, s, k in pieces)
    data += message((2, 2, message((3, 0, 1)) + b"\x98\x02\x01"), (3, 2, message((1, 2, b"identity"), (3, 0, 1), (4, 0, 0), (5, 0, 1))))
    codec = spc.Codec(data)
    assert codec.model.kind == spc.UNIGRAM and codec.model.byte_fallback
    texts = ["ab abab", "a  b", "é ab", "", "ba ab"]
    ids, equal, parity = codec.encode(texts, verify=True)
    assert all(equal) and all(parity)
    assert [x.tolist() for x in ids] == codec.reference(texts)


def test_a_model_with_pieces_over_words_is_not_cut():
    model = spc.SentencePieceModel([("<unk>", 0.0, 2), ("a▁b", -1.0, 1)])
    assert not model.splits_at_marks


ITEM = "The train leaves Berlin with 120 passengers and travels 60 km before another 45 passengers board the train at noon"


def item_rows(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, doc_id string")


def found(make_docs, bench, *texts):
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    return {(r.doc_id, r.item_id) for r in dec.leaks(make_docs(rows), bench).collect()}


def test_leaks(spark, make_docs):
    bench = item_rows(spark, ITEM, "short item", None, "Completely different benchmark words that never occur in those documents at all anyway")
    other = ITEM.replace("120", "75").replace("45", "30").replace("Berlin", "Madrid").replace("60 km", "80 miles")
    twisted = "The count 5 apples and 5 pears gives 5 fruits of kind"
    filler = "Some other words stand around here. "
    got = found(make_docs, bench, filler + ITEM + ". " + filler, filler + other, filler * 5, ITEM.upper().title(), None, "", " ".join(ITEM.split()[:6]), twisted)
    assert (0, 0) in got and (1, 0) in got
    assert not {d for d, _ in got} & {2, 4, 5, 6, 7}


def test_slots_must_be_consistent(spark, make_docs):
    item = "if 7 boxes hold as many red marbles as 7 bags hold blue marbles then how many marbles do 9 boxes hold together"
    bench = item_rows(spark, item)
    good = item.replace("7", "12").replace("9", "31")
    bad = item.replace("7 boxes", "12 boxes").replace("7 bags", "13 bags").replace("9", "31")
    merged = item.replace("9", "7")
    assert found(make_docs, bench, good) == {(0, 0)}
    assert found(make_docs, bench, bad, merged) == set()


def brute_leaks(docs, items):
    """Windows compared one by one, on exact copies of items without placeholders."""
    canon, out = dec.Canonicaliser(), set()

    def words(text):
        tokens, at, codes, plain, _ = canon(text)
        return [(int(c), tokens[k].lower()) for k, c in zip(at, codes)], plain

    windows = {}
    for i, t in items:
        w, plain = words(t)
        for k in range(len(w) - dec.WINDOW + 1):
            if sum(plain[k : k + dec.WINDOW]) >= dec.LITERALS:
                windows.setdefault(tuple(c for c, _ in w[k : k + dec.WINDOW]), []).append((i, k, len(w)))
    for d, t in docs:
        w, _ = words(t)
        covered = {}
        for k in range(len(w) - dec.WINDOW + 1):
            for i, at, n in windows.get(tuple(c for c, _ in w[k : k + dec.WINDOW]), ()):
                covered.setdefault((i, n), set()).update(range(at, at + dec.WINDOW))
        out |= {(d, i) for (i, n), c in covered.items() if len(c) >= dec.COVERAGE * n}
    return out


def test_leaks_match_brute_force(spark, sf_dir):
    docs, bench = (read_table(spark, sf_dir.replace("sf0.001", "sf0.01"), t) for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in dec.leaks(docs, bench).collect()}
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got == want and got


def test_decontamination_edge_cases(spark, odd, empty):
    bench = item_rows(spark, ITEM, "a b c d e f g")
    assert {r.doc_id for r in dec.leaks(odd, bench).collect()} == {6}
    assert dec.leaks(empty, bench).collect() == [] and dec.leaks(odd, bench.limit(0)).collect() == []
    kept = dec.decontaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 7


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in warc.SILENT.split("|"):
            self.silent += 1
        elif tag in warc.BREAKING.split():
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in warc.SILENT.split("|"):
            self.silent = max(0, self.silent - 1)
        elif tag in warc.BREAKING.split():
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def test_plain_text_matches_a_parser(spark, sf_dir):
    for r in read_table(spark, sf_dir, "pages").collect():
        parser = Text()
        parser.feed(r.html)
        parser.close()
        want = [" ".join(line.split()) for line in "".join(parser.out).split("\n")]
        assert warc.plain_text(r.html).split("\n") == [line for line in want if line]


def test_derivatives_refer_to_their_source(spark):
    page = '<html lang="de"><title>T &amp; x</title><p>a<b>b</b> &lt;c&gt;<p>d<a href="/x?a=1&amp;b=2">l</a><script>x<p></script>'
    responses = spark.createDataFrame(
        [(1, "http://e.org/", page, "2020-01-01T00:00:00Z", "<urn:uuid:s>", [("Server", "x")], "clash"), (2, None, None, None, None, None, None), (None, "u", "", None, None, None, None)],
        "page_id long, url string, html string, warc_date string, source_id string, source_headers array<struct<name: string, value: string>>, headers string",
    )
    rows = warc.derivatives(responses).collect()
    assert len(rows) == 6 and len({r.record_id for r in rows}) == 6
    conversion, metadata = (next(r for r in rows if r.page_id == 1 and r.warc_type == k) for k in ("conversion", "metadata"))
    assert conversion.block.decode() == "ab <c>\ndl"
    assert conversion.refers_to == metadata.refers_to == "<urn:uuid:s>" and metadata.concurrent_to == conversion.record_id
    assert b"outlink: /x?a=1&b=2" in metadata.block and b"source-server: x" in metadata.block and b"title: T & x" in metadata.block
    assert conversion.source_payload_digest == warc.digest(page.encode())
    data = b"".join(bytes(r.member) for r in warc.warc_members(warc.derivatives(responses)).collect())
    back = list(warc.parse(data))
    assert [b for _, b in back] == [bytes(r.block) for r in rows]
    assert [h["warc-record-id"] for h, _ in back] == [r.record_id for r in rows]


def test_warc_files_are_read(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi"
    named = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://e/"), ("Content-Length", str(len(http)))]
    (tmp_path / "a.warc.gz").write_bytes(warc.serialise(named, http) + warc.serialise([("WARC-Type", "request"), ("Content-Length", "0")], b""))
    rows = warc.read_responses(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.url, r.html, r.source_id) for r in rows] == [("http://e/", "<p>hi", "<urn:uuid:1>")]
    assert rows[0].source_headers[0].value == "text/html"
    assert warc.derivative_digests(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    with pytest.raises(ValueError):
        list(warc.parse(b"junk"))


URLS = [
    "http://a.org/x", "https://EXAMPLE.org/es/1", "http://www.example.org/en/12?x", "http://example.org/en/2", "http://b.com/fr/9#t",
    "http://b.com/de/9", "http://badorg/x", "no scheme", None, "http://c.net", "x://y://z.org/q", "http://c.net/de/q", "http://a.org/x",
]


def brute_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def brute_verdicts(urls):
    import math
    from collections import Counter
    from statistics import mean, pstdev

    def rule(host, path):
        fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        return max(fits, key=lambda r: len(r[0] + r[1]), default=None)

    def symbols(host, path):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host + path)
        s = [url_filter.ALPHABET.find("0" if c in "0123456789" else c) + 1 for c in low]
        s = [31, 31, *s, 31]
        return [tuple(s[i - 2 : i + 1]) for i in range(2, len(s))]

    parts = [brute_parts(u) for u in urls]
    rules = [rule(*p) for p in parts]

    def aside(host, path):
        h = xxhash.xxh64_intdigest((11).to_bytes(4, "little"), 42)
        for x in (host, path):
            h = xxhash.xxh64_intdigest(x.encode(), h)
        return (h - (1 << 64) * (h >> 63)) % url_filter.HELD == 0

    held = [aside(*p) for p in parts]
    grams = {v: Counter(g for p, r, a in zip(parts, rules, held) if r and r[2] == v and not a for g in symbols(*p)) for v in ("allow", "block")}

    def p(v, g):
        c = grams[v]
        total = sum(c.values())
        p1 = (sum(n for x, n in c.items() if x[2] == g[2]) + 0.5) / (total + 16)
        two = Counter()
        for x, n in c.items():
            two[x[1:]] += n
        of = {x: n for x, n in two.items() if x[0] == g[1]}
        p2 = (two[g[1:]] + len(of) * p1) / (sum(of.values()) + len(of)) if of else p1
        of = {x: n for x, n in c.items() if x[:2] == g[:2]}
        return (c[g] + len(of) * p2) / (sum(of.values()) + len(of)) if of else p2

    llr = [mean(math.log(p("allow", g)) - math.log(p("block", g)) for g in symbols(*x)) for x in parts]
    of = {v: [s for s, r, a in zip(llr, rules, held) if r and r[2] == v and a] for v in ("allow", "block")}
    rest = {v: [s for s, r, a in zip(llr, rules, held) if r and r[2] == v and not a] for v in ("allow", "block")}
    of = {v: of[v] or rest[v] for v in of}
    ma, sa, mb, sb = mean(of["allow"]), pstdev(of["allow"]), mean(of["block"]), pstdev(of["block"])
    t = (ma * sb + mb * sa) / (sa + sb)
    return [(*x, r and r[0] + r[1], r[2] if r else "allow" if s >= t else "block") for x, r, s in zip(parts, rules, llr)]


def test_url_verdicts_match_brute_force(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    odd = spark.createDataFrame([(1000 + i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://q.org", "", "")], "page_id long, url string, host string, rule string")
    rows = pages.unionByName(odd.select("page_id", "url")).collect()
    got = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("z")))
    got = sorted(map(tuple, got.collect()), key=repr)
    want = brute_verdicts([r.url for r in rows])
    assert got == sorted(((r.page_id, *w) for r, w in zip(rows, want)), key=repr)


def test_urls_edge_cases(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_verdicts(none).collect() == []
    same = spark.createDataFrame([(1, "http://x.net/a"), (1, "http://x.net/a"), (1, None)], "page_id long, url string")
    got = url_filter.url_verdicts(same).collect()
    assert len(got) == 3 and {r.verdict for r in got} == {"allow"}


def test_responses_keep_source_headers_and_digests(spark):
    import gzip

    body = "<html><head><title>Caf\u00e9</title></head><body>\u00e9t\u00e9</body></html>".encode("latin-1")
    packed = gzip.compress(body)
    chunked = f"{len(packed):x}\r\n".encode() + packed + b"\r\n0\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nX-A: 1\r\n\r\n"
    named = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://x.org/"), ("WARC-Date", "2020-01-02T03:04:05Z")]
    rows = []
    for extra in ([("WARC-Payload-Digest", "sha1:GIVEN")], []):
        block = http + chunked
        rows.append((warc.serialise([*named, *extra, ("Content-Length", str(len(block)))], block),))
    made = warc.derivatives(warc.read_responses(spark.createDataFrame(rows, "content binary"))).collect()
    assert {r.source_payload_digest for r in made} == {"sha1:GIVEN", warc.digest(chunked)}
    for r in made:
        text = bytes(r.block).decode()
        assert r.warc_date == "2020-01-02T03:04:05Z" and r.refers_to == "<urn:uuid:1>"
        if r.warc_type == "conversion":
            assert text == "\u00e9t\u00e9"
        else:
            assert "title: Caf\u00e9\r\n" in text and "source-x-a: 1\r\n" in text


def test_records_without_a_date_are_dated_when_written(spark):
    pages = spark.createDataFrame([(1, "http://x.org/", "<p>a"), (None, None, None)], "page_id long, url string, html string")
    records = warc.derivatives(pages)
    assert {r.warc_date for r in records.collect()} == {None} and {r.page_id for r in records.collect()} == {1, None}
    members = [bytes(r.member) for r in warc.warc_members(records, "2021-01-01T00:00:00Z").collect()]
    assert all(h["warc-date"] == "2021-01-01T00:00:00Z" for m in members for h, _ in warc.parse(m))


def test_pages_of_unclosed_tags_take_linear_time():
    import time

    def took(n):
        page = "<a href=x " * n + "<title " * n + "<script " * n
        start = time.perf_counter()
        warc.derive(1, "u", page, None, [])
        return time.perf_counter() - start

    took(100)
    assert took(40_000) < 60 * max(took(2_000), 1e-3)
