"""WARC packages, telephony, packing, URL filter: exact round trips and odd rows."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeworks.llm import packing, queries, telephony, urlfilter, warczip
from noticeworks.tables import new_path

from ..conftest import SMALL


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    members = [("a.txt", b"x" * 1000), ("é.bin", bytes(range(256))), ("empty", b"")]
    raw = warczip.package(members, zip64=zip64, comment=b"\n")
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert [(n, z.read(n)) for n in z.namelist()] == members and z.testzip() is None
    read = lambda at, n: raw[at : at + n]
    found = warczip.directory(read, len(raw))
    assert [(m.name, read(warczip.member_start(read, m), m.size)) for m in found] == members


def test_foreign_packages_are_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"payload")
        z.writestr("deflated", b"y" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"a note"
    raw = out.getvalue()
    read = lambda at, n: raw[at : at + n]
    big, deflated = warczip.directory(read, len(raw))
    assert read(warczip.member_start(read, big), big.size) == b"payload"
    with pytest.raises(warczip.BadArchive):
        warczip.member_start(read, deflated)
    for broken in (b"", b"PK", raw[:40]):
        with pytest.raises(warczip.BadArchive):
            warczip.directory(lambda at, n, b=broken: b[at : at + n], len(broken))


def test_warc_round_trip(spark):
    html = [(1, "http://a/\n", "<p>ü</p>"), (2, "u", "<p>ü</p>"), (3, None, None), (4, "u", ""), (5, "u", "<p>ü</p>"), (5, "u", "<p>ü</p>"), (None, "u", "<p>ü</p>"), (6, "u", "x\r\n\r\ny" * 50_000)]
    pages = spark.createDataFrame([(*r, "x") for r in html], "page_id long, url string, html string, body string").repartition(3)
    path = new_path(spark, "warc")
    warczip.write_packages(pages, path, package_bytes=1000)
    got = warczip.read_packages(spark, path).collect()
    assert len(got) == len(html)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to, by[2].refers_to, by[3].refers_to) == ("revisit", 5, 5, 4)
    assert by[5].record_type == by[4].record_type == "response" and by[None].refers_to == 5
    body = ("x\r\n\r\ny" * 50_000).encode()
    assert by[6].payload == body and by[6].payload_digest == warczip.base32_sha1(body) and by[3].payload_bytes == 0
    empty = new_path(spark, "warc")
    warczip.write_packages(pages.limit(0), empty)
    assert warczip.read_packages(spark, empty).count() == 0


def test_records_are_read_by_their_ranges(spark, tmp_path, monkeypatch):
    """No read comes near the package's size, with ZIP64 records, a comment that holds the end record's signature, and
    a second archive; a range beyond the records fails."""
    import json

    records = [zlib.compressobj(6, zlib.DEFLATED, 31) for _ in range(40)]
    bodies = []
    for i, c in enumerate(records):
        payload = bytes([65 + i % 26]) * (3000 + i) + np.random.default_rng(i).bytes(3000)
        raw = warczip.warc_record("response", f"u{i}", str(i), payload, length=len(payload), digest=warczip.base32_sha1(payload))
        bodies.append((c.compress(raw) + c.flush(), payload))
    parts, lines = {"one.warc.gz": b"", "two.warc.gz": b""}, ["!meta {}"]
    for i, (body, _) in enumerate(bodies):
        name = ("one.warc.gz", "two.warc.gz")[i % 2]
        lines.append(f"k{i} 20200101000000 " + json.dumps({"filename": name, "offset": str(len(parts[name])), "length": len(body)}))
        parts[name] += body
    index = "\n".join(lines).encode()
    whole = warczip.package([*((f"archive/{n}", b) for n, b in parts.items()), (warczip.INDEX, index)], zip64=True, comment=b"x" + warczip.END + b"y" * 30)
    (tmp_path / "a.wacz").write_bytes(whole)
    monkeypatch.setattr(warczip, "RANGE_BYTES", 8000)
    sizes = []
    ranges = warczip.record_ranges(lambda at, n: sizes.append(n) or whole[at : at + n], len(whole))
    assert sum(map(len, ranges)) == 40 and len(ranges) >= 20 and max(sum(r[-1]) - r[0][0] for r in ranges) <= 8000
    assert sum(sizes) < len(whole) / 2
    got = {r.page_id: bytes(r.payload) for r in warczip.read_packages(spark, str(tmp_path)).collect()}
    assert got == {i: p for i, (_, p) in enumerate(bodies)}
    broken = index.replace(b'"offset": "0"', b'"offset": "99999999"')
    bad = warczip.package([*((f"archive/{n}", b) for n, b in parts.items()), (warczip.INDEX, broken)])
    with pytest.raises(warczip.BadArchive):
        warczip.record_ranges(lambda at, n: bad[at : at + n], len(bad))


def test_short_payloads_are_responses(spark):
    path = new_path(spark, "warc")
    warczip.write_packages(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string"), path, least_bytes=3)
    assert {r.record_type for r in warczip.read_packages(spark, path).collect()} == {"response"}


def plain_mulaw(code):
    code = ~code & 0xFF
    value = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return -value if code & 128 else value


def plain_adpcm(block):
    value, index, _ = struct.unpack_from("<hBB", block)
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_codecs_equal_plain_decoders():
    tables = telephony.expansion()
    assert tables[telephony.MULAW].tolist() == [plain_mulaw(c) for c in range(256)]
    assert (tables[telephony.ALAW][0xD5], tables[telephony.ALAW][0x55], tables[telephony.ALAW].max()) == (8, -8, 32256)
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, telephony.UNIT), dtype=np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]


def test_media_round_trip(spark, odd, none):
    import wave

    media = telephony.encode_media(odd)
    got = {r.doc_id: r for r in telephony.stored_report(odd).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for i, r in got.items():
        payload = telephony.pad(texts[i])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[i]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len(payload) % telephony.UNIT == 0 and got[1].payload_bytes == telephony.UNIT and got[8].feature == got[9].feature
    pcm = telephony.decode_media(media).first()
    assert pcm.rate == 8000 and len(pcm.pcm) % 2 == 0
    with pytest.raises(wave.Error):  # a true WAV file, of a format that the standard library knows by number only
        wave.open(io.BytesIO(telephony.wav(b"x" * 576, telephony.MULAW)))
    assert telephony.stored_report(none).count() == 0
    with pytest.raises(ValueError):
        telephony.parse_wav(b"RIFFxxxxWAVE")


def test_resampling():
    x = np.array([0, 100, -100], np.int16)
    assert telephony.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert telephony.resample(x, 8000, 8000) is x and telephony.resample(x, 16000, 8000).tolist() == [50, -100]
    assert len(telephony.resample(x, 8000, 6000)) == 2


def plain_alaw(code):
    code ^= 0x55
    exponent, step = code >> 4 & 7, (code & 15) << 4
    value = step + 8 if exponent == 0 else (step + 264) << (exponent - 1)
    return value if code & 128 else -value


def test_media_query_equals_plain_version(spark, corpus):
    got = {r.doc_id: r for r in queries.op6_telephony(spark, SMALL).collect()}
    assert len(got) == len(corpus)
    for i, text in zip(corpus.doc_id, corpus.text, strict=True):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        codec = zlib.crc32(payload) % 3
        if codec == 2:
            wide = [x for at in range(0, len(payload), 576) for x in plain_adpcm(payload[at : at + 576])]
            wide += wide[-1:] * (len(wide) % 2)
            pcm = [(a + b) >> 1 for a, b in zip(wide[::2], wide[1::2], strict=True)]
        else:
            pcm = [(plain_mulaw, plain_alaw)[codec](x) for x in payload]
        sound = struct.pack(f"<{len(pcm)}h", *pcm)
        turns = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
        feature = f"{('mulaw', 'alaw', 'ima_adpcm')[codec]}:{len(pcm)}:{max(map(abs, pcm))}:{sum(map(abs, pcm)) // len(pcm)}:{turns}:{zlib.crc32(sound):08x}"
        media = telephony.wav(payload, telephony.CODECS[codec])
        assert payload in media and got[i].feature == feature
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32, got[i].media_bytes, got[i].media_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    for i, own in ids.items():
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist() and sum(p.length for p in pieces) == len(own)
        assert all(p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(own) for p in pieces)
    padding = 0
    for s in {r.sequence_id for r in rows}:
        pieces = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        used = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist() and used <= 2048
        assert {p.sequence_length for p in pieces} == {used if used & (used - 1) == 0 else 2048}
        padding += pieces[0].sequence_length - used
    return padding, sum(map(len, ids.values()))


def test_packing(spark, corpus):
    rows = queries.op8_packing(spark, SMALL).collect()
    padding, total = check_packing(rows, dict(zip(corpus.doc_id, corpus.text, strict=True)))
    assert padding < 2048 and total > 50_000
    sums = {}
    for r in rows:
        sums[r.step_group] = sums.get(r.step_group, 0) + r.length
    assert max(sums.values()) < 1.5 * min(sums.values())


def test_packing_rounds_and_odd_rows(spark, odd, none, monkeypatch):
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None and r.doc_id != 5}
    rows = packing.pack_documents(odd.filter("doc_id <> 5"), queries.tokenizer_path()).collect()
    check_packing(rows, texts)
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0
    assert packing.pack_documents(odd, queries.tokenizer_path()).filter("doc_id = 5").agg(F.sum("length")).first()[0] == 4
    with pytest.raises(ValueError):
        packing.pack_documents(odd, "x", tiers=(3,))


ODD_TEXTS = ["", " ", "  ", "a  b", "a \n b", "x\n ", "x \n\n  y", "it's  we'll\t\tgo \u3000 x\x1c\x1d z", "<|endoftext|> a", "  b", "a\0 b", "é ñ 12 3a", "trail  ", "\n\n\n a", "a\r\n b", "漢字 かな 12,345.6"]


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    encode = packing.encoder(queries.tokenizer_path()).encode_marked
    assert [encode(t).tolist() for t in ODD_TEXTS] == [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD_TEXTS]


def test_url_rules(spark):
    urls = ["https://example.com/en/x", "http://WWW.Example.COM/en/?q", "//example.com/en/", "http://shop.net/es/", "http://shop.net/es", "http://net/fr/a#b", "http://com", "http://com/", "http://notexample.com/en/", None, "", "x://", "a\n://b.com/c", "http://example.com:80/en/", "http://" + "a." * 3000 + "net/fr/" + "x" * 9000, "http://net.", "http://.net/es/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(0, urls[0], "x", "y")], "page_id long, url string, rule string, key string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, spark.sql(queries.URL_RULES).toDF("host", "path", "action")).orderBy("page_id").collect()]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

    def judge(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    assert got == [judge(urls[0]), *map(judge, urls)]
    no_rules = spark.createDataFrame([], "host string, path string, action string")
    assert {r.verdict for r in urlfilter.judge_urls(pages, no_rules, default="block").collect()} == {"block"}
    assert urlfilter.judge_urls(pages.limit(0), no_rules).count() == 0


def test_bloom_loses_no_key(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    asked = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    passed = {r.key for r in urlfilter.maybe_listed(asked, "key", urlfilter.bloom_blocks(keys, "key", 64), 64).collect()}
    assert {f"k{i}" for i in range(500)} <= passed and len(passed) < 1500


def test_paths_as_spark_lists_them():
    names = {"file:/a/b.zip": "file:///a/b.zip", "file:///a/b.zip": "file:///a/b.zip", "s3a://bucket/a.zip": "s3://bucket/a.zip", "s3n://bucket/a.zip": "s3://bucket/a.zip", "gs://bucket/a": "gs://bucket/a", "hdfs://host:1/a": "hdfs://host:1/a"}
    assert {k: warczip.arrow_uri(k) for k in names} == names
