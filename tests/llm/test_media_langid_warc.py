"""Media columns by round trip, language ID by held-out accuracy, WARC derivatives by parsing them back."""

import base64
import gzip
import hashlib
import html
import io
import json
import random
import re
import time
import uuid
import wave
import zlib

import numpy as np
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from driftglass.llm import langid, media, warc


def test_media_round_trip(odd, small):
    for docs in (odd, small):
        got = {(r["doc_id"], r["n_bytes"], r["payload_sha256"]): r for r in media.media_features(docs).collect()}
        for r in docs.collect():
            data = (r["text"] or "").encode()
            payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
            row = got[r["doc_id"], len(data), hashlib.sha256(payload).hexdigest()]
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setparams((1, 1, media.RATE, 0, "NONE", ""))
                w.writeframes(payload)
            assert row["payload_bytes"] == len(payload) and row["tail_crc32"] == zlib.crc32(payload[-32:])
            assert row["media_bytes"] == len(out.getvalue()) and row["media_sha256"] == hashlib.sha256(out.getvalue()).hexdigest()


def plain_pairs(payload):
    """Peak pairs by a plain transform of each frame, peak by peak; float32 noise decides nothing on these texts but near-ties, which the test leaves out."""
    frames = [payload[i : i + 576] for i in range(0, len(payload) - 575, 288)]
    wave_table = np.exp(-2j * np.pi * np.arange(576)[:, None] * np.arange(289)[None, :] / 576)
    peaks, sure = [], True
    for f in frames:
        x = np.array(list(f), float) - 128
        power = np.abs(((x - x.mean()) * np.hanning(576)) @ wave_table)
        own = []
        for low, high in media.BANDS:
            band = power[low:high]
            first, second = np.sort(band)[::-1][:2]
            sure &= bool(first - second > 1e-3 and abs(first - 1.5 * band.mean()) > 1e-3 and abs(first - 1.0) > 1e-3)
            own.append(low + int(band.argmax()) if first > 1.5 * band.mean() and first > 1.0 else None)
        peaks.append(own)
    found = []
    for t, own in enumerate(peaks):
        for b, f in enumerate(own):
            for dt in range(media.REACH + 1):
                if t + dt < len(peaks) and f is not None and (g := peaks[t + dt][(b + 1) % 4]) is not None:
                    found.append((f << 18 | g << 6 | dt << 2 | b) << 32 | t)
    return sorted(found, key=lambda c: (c & 0xFFFFFFFF, c >> 32)), sure


def test_features_against_a_plain_transform(small):
    checked = 0
    for r in small.where("length(text) between 300 and 6000").limit(40).collect():
        payload = media.pad_payload(r["text"].encode())
        want, sure = plain_pairs(payload)
        if sure:
            checked += 1
            assert media.peak_pairs(payload).tolist() == want
    assert checked >= 10


def test_media_equal_texts_equal_features(odd):
    rows = media.media_features(odd.where("doc_id = 2")).collect()
    assert len(rows) == 2 and rows[0] == rows[1]


def test_peaks_follow_tones(monkeypatch):
    t = np.arange(576 * 20)
    tone = (128 + 60 * np.sin(2 * np.pi * 40 * t / 576) + 60 * np.sin(2 * np.pi * 100 * t / 576)).astype(np.uint8).tobytes()
    codes = media.peak_pairs(tone)
    pairs = {(c >> 50, c >> 38 & 0xFFF) for c in codes.tolist()}
    assert (40, 100) in pairs
    assert (np.diff(codes & 0xFFFFFFFF) >= 0).all()
    assert len(media.peak_pairs(bytes([128]) * 5760)) == 0
    monkeypatch.setattr(media, "RUN", 3)
    assert (media.peak_pairs(tone) == codes).all()


def test_media_null_and_empty_and_clashing(spark, none, odd):
    assert media.media_features(none).count() == 0
    df = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert media.fingerprint_wav(df).first()["codes"] is None
    assert media.store_wav(odd.withColumn("media", F.lit(3))).columns[-2:] == ["n_bytes", "media"]


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_sees_the_text_alone(odd):
    dictionaries = {"en": b"the cat and the dog " * 30, "fr": b"le chat et le chien sur la table " * 30}
    seen = langid.identify(odd, dictionaries)
    other = langid.identify(odd.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 1), dictionaries)
    key = ["lang_pred", "score", "rejected"]
    assert sorted(map(str, seen.select(key).collect())) == sorted(map(str, other.select(key).collect()))
    got = {r["doc_id"]: r for r in seen.collect()}
    assert got[1]["lang_pred"] == "en" and got[8]["lang_pred"] == "fr"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (3, 4, 5, 7))


def test_language_id_ties_empty_and_untrained(spark, none, odd):
    same = langid.Classifier({"b": b"some words of a text", "a": b"some words of a text"})
    assert same.predict("some words") == ("b", 0.0, True)
    assert langid.language_id(none).count() == 0
    blind = langid.language_id(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in blind.collect()} == {"und"}
    assert langid.identify(odd.withColumn("score", F.lit("x")), {}).columns[-3:] == ["lang_pred", "score", "rejected"]


def test_numbers_of_any_kind_are_no_letters():
    model = langid.Classifier({"en": b"the cat and the dog " * 30, "fr": b"le chat et le chien sur la table " * 30})
    for text in ("\u00bd\u00b2", "\u2167", "\u2460 \u00b2", "12 _ \u0301"):
        assert model.predict(text) == ("und", 0.0, True), text
    assert langid.letters("\u0939\u093f\u0928\u094d\u0926\u0940 x2y") == "\u0939\u093f\u0928\u094d\u0926\u0940 x y".encode()


def test_sizes_against_plain_compression(small):
    """Whole texts, window by window, by one compressor for each language and window; predictions follow from the sizes."""
    fitted = langid.fit(small)
    model = langid.Classifier(fitted)
    for r in small.where("text is not null").limit(60).collect():
        data = b" " + " ".join(regex.findall(r"\p{L}[\p{L}\p{M}]*", r["text"].lower())).encode() + b" "
        sizes = {}
        for lang, own in fitted.items():
            how = zstandard.ZstdCompressionParameters.from_level(
                langid.LEVEL, source_size=langid.WINDOW, dict_size=len(own), strategy=zstandard.STRATEGY_DFAST, min_match=4, write_content_size=False, write_dict_id=False
            )
            total, at = 0, 0
            while at < len(data):
                held = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                total += len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(data[at : at + langid.WINDOW] + langid.TAIL))
                at += langid.WINDOW
            sizes[lang] = total
        lang, score, rejected = model.predict(r["text"])
        first, second = sorted(sizes.values())[:2]
        if data.strip():
            assert rejected == (second - first <= langid.MARGIN * first)
            assert abs(sizes[lang] - first) <= 0.005 * first and (second - first <= 0.01 * first or sizes[lang] == first)


def test_whole_text_counts():
    model = langid.Classifier({"en": b"the cat and the dog ran over the hill " * 40, "fr": b"le chat et le chien sur la table dans la maison " * 40})
    assert model.predict("the cat " * 30 + "le chat et le chien " * 4000)[0] == "fr"


def test_language_id_rejects_narrow_margins(small):
    dictionaries = langid.fit(small)
    rng = np.random.default_rng(3)
    model, ties = langid.Classifier(dictionaries), langid.Classifier(dictionaries, min_margin=0.0)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 600)) for _ in range(40)]
    assert sum(model.predict(t)[2] for t in noise) >= 38 > sum(ties.predict(t)[2] for t in noise)
    assert model.predict("быстрая лиса прыгает через собаку " * 9)[2]
    held = small.where(langid.held_out() & F.col("text").isNotNull()).select("lang", "text").collect()
    found = [(model.predict(r["text"]), r["lang"]) for r in held]
    assert sum(p[2] for p, lang in found if p[0] == lang) <= 0.05 * len(held)


def test_one_language_rejects_the_others(small):
    fitted = langid.fit(small)
    held = [r for r in small.where(langid.held_out()).select("lang", "text").collect() if r["text"] and len(r["text"]) > 200]
    one = langid.Classifier({"en": fitted["en"]})
    own, other = ([one.predict(r["text"])[2] for r in held if (r["lang"] == "en") == same] for same in (True, False))
    assert own and other and sum(own) <= 0.1 * len(own) and sum(other) >= 0.9 * len(other)


PAGES = [
    (1, "http://a.example/x", '<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><p>One&nbsp;two<br>three</p><!-- no --><a href="/l?a=1&amp;b=2">link</a></body></html>'),
    (2, None, None), (3, "http://b.example", ""), (4, "u", "HTTP/1.1 404 Not Found\r\nContent-Type: text/plain\r\nX-Y: z\r\n\r\ngone < here"), (1, "http://a.example/x", "plain"), (None, "n", "<p>" + "w " * 50000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record", F.lit(1))


def test_derivatives_link_back(pages):
    sources = {warc.parse(r["record"])[0]["WARC-Record-ID"]: warc.parse(r["record"]) for r in warc.responses(pages).collect()}
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 2 * len(PAGES)
    for r in rows:
        headers, block = warc.parse(r["record"])
        source, source_block = sources[headers["WARC-Refers-To"]]
        assert headers["WARC-Type"] == r["record_type"] and headers["WARC-Target-URI"] == source["WARC-Target-URI"] == headers["WARC-Refers-To-Target-URI"]
        assert headers["WARC-Block-Digest"] == warc.digest(block) and source["WARC-Block-Digest"] == warc.digest(source_block)
        assert headers["WARC-Source-Payload-Digest"] == source["WARC-Payload-Digest"] == warc.digest(warc.split_http(source_block)[2])
        assert r["record"].endswith(b"\r\n\r\n") and len(block) == r["block_bytes"]
        if r["record_type"] == "metadata":
            envelope = json.loads(block)["Envelope"]
            assert envelope["WARC-Header-Metadata"] == source
            assert envelope["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"] == warc.split_http(source_block)[1]
    assert len({r["record_id"] for r in rows}) == len(rows)


def test_text_and_metadata():
    assert warc.page_text(PAGES[0][2]) == "A & B\nOne two\nthree\nlink"
    assert warc.page_metadata(PAGES[0][2]) == {"Title": "A & B", "Links": [{"path": "A@/href", "url": "/l?a=1&b=2"}]}
    assert warc.page_text("a < b &lt; c") == "a < b < c"


def test_sources_keep_their_headers(pages):
    row = next(r for r in warc.derive(warc.responses(pages)).collect() if r["page_id"] == 4 and r["record_type"] == "metadata")
    meta = json.loads(warc.parse(row["record"])[1])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert meta["Response-Message"] == "HTTP/1.1 404 Not Found" and meta["Headers"]["X-Y"] == "z" and meta["Entity-Length"] == 11


def metadata_of(page):
    (_, _, meta), (_, _, conversion) = warc.derivatives(warc.response(1, "u", page))
    found = json.loads(warc.parse(meta)[1])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    return found, warc.parse(conversion)


def test_repeated_headers_all_stay():
    page = "HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nVia: x\r\nSet-Cookie: b=2; Path=/\r\nX-Long: one\r\n  two\r\nSet-Cookie: a=1\r\n\r\nbody"
    found, (_, block) = metadata_of(page)
    assert found["Response-Message"] == "HTTP/1.1 200 OK" and block == b"body"
    assert list(found["Headers"].items()) == [("Set-Cookie", ["a=1", "b=2; Path=/", "a=1"]), ("Via", "x"), ("X-Long", "one two")]
    record = b"WARC/1.1\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert warc.parse(record) == ({"WARC-Concurrent-To": ["<a>", "<b>"], "Content-Length": "2"}, b"hi")


def test_pages_that_only_look_like_http():
    for page in ("HTTP/2 explained in ten lines", "HTTP/1.1 200 OK", "HTTP/2 explained\r\n\r\nmore", "HTTP/1.1 2000 things\r\n\r\nmore", "HTTP/1.1 200 OK\r\nServer: x"):
        found, (headers, block) = metadata_of(page)
        assert found["Response-Message"] == "HTTP/1.1 200 OK" and found["Headers"]["Content-Type"] == "text/html; charset=utf-8"
        assert found["Entity-Length"] == len(page) and headers["WARC-Source-Payload-Digest"] == warc.digest(page.encode())
        assert block.decode().split() == page.split()
    found, (_, block) = metadata_of("HTTP/2 204\r\n\r\nrest")
    assert found["Response-Message"] == "HTTP/2 204" and found["Headers"] == {} and block == b"rest"


def test_links_of_scripts_and_noscript():
    page = '<script src="/a.js">var x = "<a href=/no>";</script><noscript><img src=/b.png></noscript><!-- <a href="/gone"> --><style>/* <a href=/no> */</style><a href="/c">c</a><script src="/d.js">'
    assert warc.page_metadata(page)["Links"] == [{"path": "SCRIPT@/src", "url": "/a.js"}, {"path": "IMG@/src", "url": "/b.png"}, {"path": "A@/href", "url": "/c"}, {"path": "SCRIPT@/src", "url": "/d.js"}]
    assert warc.page_text(page) == "c"


OLD_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
OLD_OPAQUE = re.compile(r"<!--.*?(?:-->|\Z)|(<(script|style)\b[^>]*>).*?(?:</\2\s*>|\Z)", re.S | re.I)
OLD_LINK = re.compile(r"""<(a|area|link|img|script|iframe)\b[^>]*?\s(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def plain_page(page):
    """Text, title and links by substitution over the whole page: slow on broken pages, the same on others."""
    text = OLD_HIDDEN.sub(" ", page)
    text = re.sub(rf"</?(?:{'|'.join(warc.BREAKS)})\b[^>]*>", "\n", text, flags=re.I)
    text = re.sub(r"<[/!?a-zA-Z][^>]*>", "", text)
    text = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[^\S\n]+", " ", html.unescape(text).replace("\r", "\n"))).strip()
    title = re.search(r"<title\b[^>]*>(.*?)</title\s*>", page, re.S | re.I)
    links = [{"path": f"{m[1].upper()}@/{m[2].lower()}", "url": html.unescape(m[3] or m[4] or m[5] or "")} for m in OLD_LINK.finditer(OLD_OPAQUE.sub(lambda m: m[1] or " ", page))]
    return text, {"Title": html.unescape(title[1]).strip() if title else None, "Links": links}


def test_pages_against_a_plain_version(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r["html"]]
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<b>", "</b>", "<br/>", "text &amp; more", " \n ", "<!-- a <b> -->", "<script>x < y</script>", "<noscript><img src=/n.png>gone</noscript>", "<a href='/q?a=1&amp;b'>", "</a>", "<style>p{}</style>", '<img alt="x" src="/i.png">', "a < b", "<title>T &lt; t</title>", "<!DOCTYPE html>", "&#65;&#0066;", "<li class=x>", "</LI >", "<template><p>t</p></template>"]
    pages += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert len(pages) > 3100
    for page in pages:
        assert (warc.page_text(page), warc.page_metadata(page)) == plain_page(page), page


def test_quoted_values_may_hold_a_tag_end():
    assert warc.page_metadata('<a title="x > y" href="/a>b">t</a>')["Links"] == [{"path": "A@/href", "url": "/a>b"}]
    assert warc.page_text('<a title="x > y" href="/a>b">t</a> u') == "t u"
    assert warc.page_text('<a title="x >t <b>u</b>') == "t u"
    assert warc.page_text("a &#" + "1" * 6000 + "; b &#" + "0" * 6000 + "65; &#x41;") == "a \ufffd b A A"
    assert warc.page_text("open <a href=") == "open <a href="


@pytest.mark.parametrize("bit", ["<a ", "<title>", "<", "<!", "</a", '<a x="', "<a x='>", '<a x=">" ', "<script>", "<noscript>", "<script>a</script", "<!--", "&#", "&#1", "<a href=", "= ", "<p =", "<template><script>", "\n ", "<a\n", "x>", "<title></title", "<a x='\"' \">"])
def test_hostile_pages_take_linear_time(bit):
    page = (bit * (1_000_000 // len(bit) + 1))[:1_000_000]
    for page in (page, page + ">", page + '">'):
        began = time.process_time()
        warc.derivatives(warc.response(1, "u", page))
        assert time.process_time() - began < 5, bit  # quadratic work takes minutes here
    warc.derivatives(warc.response(1, "u", "HTTP/1.1 200 OK\r\nA: b\r\n" + " c\r\n" * 200_000 + "\r\nx"))


def test_registered_query_against_plain_records(spark):
    """Every row of the query follows from the page by the standard's rules, with the plain page parser."""
    from driftglass.llm import queries

    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = queries.op2_warc_derivatives(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 2 * len(pages)
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    for r in rows:
        page = pages[r["page_id"]]["html"] or ""
        assert not page.startswith("HTTP/") and r["target_uri"] == (pages[r["page_id"]]["url"] or "").strip()
        assert r["source_payload_digest"] == sha1(page.encode())
        source = uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(["response", r["page_id"], r["target_uri"], r["source_payload_digest"]]))
        assert r["refers_to"] == f"<urn:uuid:{source}>" and r["record_id"] == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([r['record_type'], r['refers_to']]))}>"
        if r["record_type"] == "conversion":
            text = plain_page(page)[0].encode()
            assert (r["block_bytes"], r["block_digest"]) == (len(text), sha1(text))


def test_write_records(pages, tmp_path):
    records = warc.derive(warc.responses(pages)).coalesce(1)
    files = warc.write_records(records, f"file://{tmp_path}").collect()
    assert sum(f["records"] for f in files) == 2 * len(PAGES)
    assert gzip.decompress((tmp_path / files[0]["file"]).read_bytes()) == b"".join(r["record"] for r in records.collect())


def test_write_records_file_by_file(pages, tmp_path):
    records = warc.derive(warc.responses(pages)).coalesce(1)
    files = sorted(warc.write_records(records, f"file://{tmp_path}", file_bytes=600).collect())
    assert len(files) > 2 and sum(f["records"] for f in files) == 2 * len(PAGES) and {p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")} == {f["file"] for f in files}
    assert b"".join(gzip.decompress((tmp_path / f["file"]).read_bytes()) for f in files) == b"".join(r["record"] for r in records.collect())


def test_one_learned_language(spark):
    """Texts with letters get it even where they are smaller without its dictionary; then they are rejected."""
    model = langid.Classifier({"en": b" the of and to in that with for was " * 30})
    found = {t: model.predict(t) for t in ("the and of that with", "xqzj vvkw pplm zzrt", "12 34", "")}
    assert [p[0] for p in found.values()] == ["en", "en", "und", "und"] and found["xqzj vvkw pplm zzrt"][2]


def test_empty_pages(spark):
    assert warc.derive(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
