"""ARC files by their headers and lengths, their WARC form, and the way there and back."""

import gzip
import hashlib

import pytest

from quayside.llm import web_archives as wa

HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\nX-Page-Id: 7\r\n\r\n"
INSIDE = HTTP + b"<p>\nhttp://x/ 1.2.3.4 19970101000000 text/html 5\nhello\nWARC/1.1\r\n</p>"


def v1(*records):
    body = b"1 0 me\n" + wa.DEFINITION[1] + b"\n"
    return b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(body) + body + b"".join(b"\n" + h + b"\n" + b for h, b in records)


def v2(*records):
    body = b"2 0 me\n" + wa.DEFINITION[2] + b"\n"
    return b"filedesc://new.arc 0.0.0.0 19960923142103 text/plain 200 - - 0 new.arc %d\n" % len(body) + body + b"".join(b"\n" + h + b"\n" + b for h, b in records)


def test_versions_have_their_own_fields():
    old = v1((b"http://a/ b 1.2.3.4 19970102030405 text/html %d" % len(INSIDE), INSIDE), (b"dns:a 1.2.3.4 199701020304 text/dns 3", b"a\nb"))
    new = v2((b"http://a/ 1.2.3.4 19970102030405 text/html 200 abc - 209 new.arc %d" % len(INSIDE), INSIDE), (b"http://b/ 1.2.3.4 19970102030405 image/gif 200 abc - 209 new.arc 4", b"GIF8"))
    for content in (old, gzip.compress(old), gzip.compress(old[:100]) + gzip.compress(old[100:])):
        (name, a), (_, b) = wa.read_arc(content, "file")
        assert (name, a.url, a.ip, a.date, a.mime, a.block, a.problem) == ("old.arc", b"http://a/ b", b"1.2.3.4", "1997-01-02T03:04:05Z", b"text/html", INSIDE, None)
        assert (b.url, b.date, b.block, wa.warc_type(b)) == (b"dns:a", "1997-01-02T03:04:00Z", b"a\nb", ("resource", b"text/dns"))
    (_, a), (_, b) = wa.read_arc(new, "file")
    assert (a.block, a.url, b.block, wa.warc_type(a)[0], wa.warc_type(b)) == (INSIDE, b"http://a/", b"GIF8", "response", ("resource", b"image/gif"))
    assert wa.identifier("x", a) == wa.identifier("x", a) != wa.identifier("y", a)


def test_damage_is_told_and_kept():
    cut = v1((b"http://a/ 1.2.3.4 19970102030405 text/html 100", b"short"))
    assert [(r.block, r.problem) for _, r in wa.read_arc(cut, "f")] == [(b"short", "truncated")]
    odd = v1((b"no header here", b"some bytes"), (b"http://a/ 1.2.3.4 19979902030405 text/html 5", b"hello"))
    got = [(r.block, r.problem, r.date) for _, r in wa.read_arc(odd, "f")]
    assert got == [(b"no header here\nsome bytes\n", "unreadable", "1996-09-23T14:21:03Z"), (b"hello", None, "1996-09-23T14:21:03Z")]
    whole = gzip.compress(v1((b"http://a/ 1.2.3.4 19970102030405 text/html 5", b"hello")))
    assert [r.problem for _, r in wa.read_arc(whole[:-12], "f")][-1] in ("truncated", "unreadable")
    assert list(wa.read_arc(b"", "f")) == [] == list(wa.read_warc(b""))


def test_converted_record_says_what_warc_asks_for():
    [(name, r)] = wa.read_arc(v1((b"http://a/ 1.2.3.4 19970102030405 text/html %d" % len(INSIDE), INSIDE)), "f")
    payload = INSIDE[len(HTTP) :]
    data = wa.END.join([wa.convert_record(name, r, None), wa.convert_record(name, r, {"id": "<urn:x>", "uri": "http://b/", "date": "1997-01-01T00:00:00Z"})]) + wa.END
    (_, one, block, bad), (_, two, rest, _) = wa.read_warc(data)
    assert (block, bad, rest) == (INSIDE, None, HTTP)
    assert one["warc-payload-digest"] == two["warc-payload-digest"] == b"sha256:" + hashlib.sha256(payload).hexdigest().encode()
    assert one["warc-block-digest"] == b"sha256:" + hashlib.sha256(INSIDE).hexdigest().encode()
    assert (one["warc-type"], one["warc-date"], one["warc-ip-address"], one["content-type"]) == (b"response", b"1997-01-02T03:04:05Z", b"1.2.3.4", b"application/http; msgtype=response")
    assert (two["warc-type"], two["warc-refers-to"], two["warc-refers-to-target-uri"]) == (b"revisit", b"<urn:x>", b"http://b/")
    folded = data.replace(b"WARC-Date: 1997", b"WARC-Date:\r\n 1997")
    assert next(wa.read_warc(folded))[1]["warc-date"].strip() == b"1997-01-02T03:04:05Z"
    assert [x[3] for x in wa.read_warc(data[:-10])] == [None, "truncated"]


def expected(rows, least=100):
    first, out = {}, []
    for i, _, html in rows:
        data = (html or "").encode()
        key = hashlib.sha256(data).hexdigest()
        if len(data) >= least:
            first.setdefault(key, []).append(i)
    for i, _, html in rows:
        data = (html or "").encode()
        key, known = hashlib.sha256(data).hexdigest(), None
        if len(data) >= least:
            known = min((x for x in first[key] if x is not None), default=None)
        again = known is not None and known != i
        out.append((i, len(data), key, "revisit" if again else "response", known if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes", [3_000, 32_000_000])
def test_there_and_back(spark, archive_bytes):
    texts = ["<p>é 中 😀</p>" * 20, "x" * 99, "x" * 100, "é" * 50, "", None, "line\nWARC/1.1\r\n\r\nhttp://x/ 1.2.3.4 19970101000000 text/html 5\n" * 9, "w" * 500_000]
    rows = [(k, f"http://h/{k}?a b\n", texts[k % len(texts)]) for k in range(80)] + [(900, None, texts[0]), (901, "", "alone" * 50), (902, "no colon", "odd"), (None, "http://n/", texts[0])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, type string").repartition(3)
    out = wa.archive(pages, archive_bytes=archive_bytes).collect()
    assert all(r.intact for r in out)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in out), key=str) == expected(rows)
    assert {r.uri for r in out if r.page_id in (3, 900, 902)} == {"http://h/3?a%20b%0A", "unknown:", "unknown:no%20colon"}


def test_equal_rows_and_no_rows(spark):
    pages = spark.createDataFrame([(5, "http://a/", "y" * 200)] * 3 + [(6, "http://a/", "y" * 200)], "page_id long, url string, html string")
    out = wa.archive(pages).collect()
    assert sorted((r.page_id, r.type, r.refers_to) for r in out if r.type == "revisit") == [(5, "revisit", 5), (5, "revisit", 5), (6, "revisit", 5)]
    assert len(out) == 4
    assert wa.archive(pages.limit(0)).count() == 0
