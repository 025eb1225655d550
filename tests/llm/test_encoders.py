"""BPE, packing, PII, media and URL operators against libraries and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm import bpe, mpeg_audio, packing, pii, url_filters

ODD = "abcXYZ İΣΣς ß ﬁ 'S 're'll don't I'M 123²½ éèéññ \x1c\x1f\x85\xa0 !?--__ <|endoftext|> <|startoftext|> 漢字 가각 😀👍🏽 \n\t'"


def odd_texts(n=150):
    r = random.Random(4)
    out = ["", " ", "a" * 3000, "ab" * 2000 + "!", "é" * 900, "".join(r.choice("thein") for _ in range(4000)), "x   y \n z", "\u088f\u1c89 ok"]
    return out + ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(n)] + [" ".join(r.choice(ODD.split(" ")) for _ in range(15)) for _ in range(n)]


def test_bpe_is_the_librarys():
    path = bpe.default_path()
    t, e = Tokenizer.from_file(path), bpe.encoder(path)
    for x in odd_texts():
        ids = t.encode(x, add_special_tokens=False).ids
        packed = e.encode(x)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert "".join(bpe.decode(e.merges, packed, step=7)) == t.decode(ids, skip_special_tokens=False)


def test_transducer_memory_is_bounded():
    m = bpe.encoder(bpe.default_path()).merges
    taken = 0

    def symbols():
        nonlocal taken
        for i in range(5000):
            taken += 1
            yield m.symbols[ord("thein"[i * i % 5])]

    for n, _ in enumerate(m.stream(symbols())):
        if n == 0:
            assert taken <= m.window
    assert taken == 5000


def test_byte_level_decoder():
    path = packing.default_path()
    m, t = bpe.Merges(path), Tokenizer.from_file(path)
    for x in odd_texts(30):
        ids = t.encode(x, add_special_tokens=False).ids
        d = bpe.Decoder(m)
        assert "".join([d.feed([i]) for i in ids] + [d.finish()]) == t.decode(ids, skip_special_tokens=False)


def test_byte_encoder_is_the_librarys():
    e = packing.byte_encoder(packing.default_path())
    assert e.fast is not None
    for x in odd_texts():
        assert np.frombuffer(e.encode(x), "<u4").tolist() == e.rules.encode(x, add_special_tokens=False).ids


def test_packing(spark, prose):
    texts = [prose(i, n) for i, n in enumerate((3, 900, 2500, 1, 40, 400))] + [None, "", prose(1, 900)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(8, prose(1, 900), "x")], "doc_id long, text string, part string").repartition(3)
    out = packing.pack(docs)
    assert "text" not in out.columns
    pieces = out.orderBy("sequence_id", "offset").collect()
    ids = {i: np.frombuffer(packing.byte_encoder(packing.default_path()).encode(t), "<u4").tolist() + [0] for i, t in enumerate(texts)}
    place, per_doc = 0, {}
    for p in pieces:
        assert p["sequence_id"] * 1024 + p["offset"] == place and p["offset"] + p["length"] <= 1024
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        assert bytes(p["piece_ids"]) == np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()
        per_doc.setdefault(p["doc_id"], []).append(p["length"])
        place += p["length"]
    assert {k: sum(v) for k, v in per_doc.items()} == {k: len(v) * (2 if k == 8 else 1) for k, v in ids.items()}
    assert packing.pack(docs.limit(0)).isEmpty()


def brute(t):
    out = []
    for k, rx in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(rx, t):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans():
    r = random.Random(1)
    texts = ["".join(r.choice("0123456789..@@++--  ()aZ_%\n") for _ in range(r.randint(0, 80))) for _ in range(4000)]
    texts += ["4111 1111-1111 1111", "é a@b.c b@c@d.e x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1", "+1 (375) 555-4393 ext", "0" * 200, "+" * 50, "@" * 50, "1." * 300]
    for t in texts:
        assert [s for s in pii.find_spans(t) if s[1] < pii.BASE] == brute(t)


def test_pii_added_and_masked():
    t = "a@b.co or password=e3b3ed3c, IBAN: DE89 3704 0044 0532 0130 00; account no: 12345678 https://joe:pw@h.example/x"
    kinds = {pii.KINDS[k] for _, k, _ in pii.find_spans(t)}
    assert {"email", "secret", "iban", "account", "login"} <= kinds
    assert pii.masked("a@b.co!", pii.find_spans("a@b.co!")) == "[EMAIL]!" and pii.masked(None, []) is None and pii.find_spans("the passwords of accounts") == []


def test_pii_query(spark):
    docs = spark.createDataFrame([(1, "x a@b.co", "p"), (2, None, "p"), (3, "", "p"), (3, "", "p")], "doc_id long, text string, pii string")
    got = {r["doc_id"]: r for r in pii.find_pii(docs, mask=True).collect()}
    assert got[1]["text"] == "x [EMAIL]" and got[1]["pii"][0]["start"] == 2 and got[2]["text"] is None and got[3]["pii"] == []


@pytest.mark.parametrize("n", [64, 128, 937, 1874, 1920, 6400, 64000])
def test_media_round_trip(n):
    b = ("é€x yz" * n).encode()[:n]
    m = mpeg_audio.write_audio(b)
    r = mpeg_audio.read_audio(m)
    assert r["payload"] == b and r["crc_bad"] == r["skipped"] == r["truncated"] == 0
    assert r["samples"] == 1152 * r["frames"] and r["us"] == 24_000 * r["frames"] and r["vbr"]["frames"] == r["frames"] == len(r["offsets"])
    assert all(m[o] == 0xFF for o in r["offsets"]) and r["vbr"]["bytes"] == len(m) - mpeg_audio._tags(m)[0]


def test_media_damage():
    m = bytearray(mpeg_audio.write_audio(b"a" * 6400))
    frames = mpeg_audio.read_audio(bytes(m))["offsets"]
    cut = mpeg_audio.read_audio(bytes(m[: frames[2]] + b"junk\xff" + m[frames[2] :]) + b"TAG" + bytes(125))
    assert cut["frames"] == 7 and cut["skipped"] == 5
    m[frames[1] + 10] ^= 1
    assert mpeg_audio.read_audio(bytes(m))["crc_bad"] == 1
    assert mpeg_audio.read_audio(bytes(m[:-3]))["truncated"] == 1
    for odd in (None, b"", b"\xff", b"ID3", b"\xff\xfb" * 40, bytes(1000)):
        assert mpeg_audio.read_audio(odd)["payload"] is None


def naive_crc(bits):
    c = 0xFFFF
    for b in bits:
        top = c >> 15
        c = c << 1 & 0xFFFF
        if top != b:
            c ^= 0x8005
    return c


def protected_frame(second, third, fourth, covered, ones=()):
    """A protected frame whose first `covered` bits behind the CRC are zeros but for those listed."""
    size = mpeg_audio.header(bytes((0xFF, second, third, fourth)))[0]
    bits = [0] * (8 * (size - 6))
    for i in ones:
        bits[i] = 1
    body = int("".join(map(str, bits)), 2).to_bytes(size - 6, "big")
    head = [int(b) for x in (third, fourth) for b in f"{x:08b}"]
    return bytes((0xFF, second, third, fourth)) + naive_crc(head + bits[:covered]).to_bytes(2, "big") + body


@pytest.mark.parametrize(
    "frame",
    [
        protected_frame(0xFE, 0x80, 0x00, 256),  # Layer I, stereo
        protected_frame(0xFE, 0x80, 0xC0, 128, (3, 127)),  # Layer I, mono
        protected_frame(0xFE, 0x80, 0x40, 4 * (4 + 32)),  # Layer I, joint stereo, 4 bands apart
        protected_frame(0xFC, 0x80, 0x00, 176),  # Layer II, stereo, 64 kbit/s a channel
        protected_frame(0xFC, 0x80, 0x00, 176 + 4, (3, 7)),  # two subbands in use: their scale factor selectors count
        protected_frame(0xFC, 0xC0, 0x00, 2 * 94),  # Layer II, 112 kbit/s a channel
        protected_frame(0xFC, 0x10, 0xC0, 26),  # Layer II, mono at 32 kbit/s
        protected_frame(0xF4, 0x80, 0xC0, 75),  # MPEG-2 Layer II, mono
    ],
)
def test_checksums_of_other_layers(frame):
    good = mpeg_audio.read_audio(frame * 4)
    assert (good["frames"], good["crc_ok"], good["crc_bad"]) == (4, 4, 0)
    bad = bytearray(frame)
    bad[6] ^= 0x10
    assert mpeg_audio.read_audio(bytes(bad) + frame * 3)["crc_bad"] == 1


def test_media_tags():
    audio = protected_frame(0xFC, 0x80, 0x00, 176) * 3
    old = b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + b"Album".ljust(30, b" ") + b"1999" + b"note".ljust(28, b"\0") + b"\0\7" + b"\x11"
    frame22 = b"TT2\0\0\6\0Hello"
    v22 = b"ID3\2\0\0" + mpeg_audio._safe(len(frame22)) + frame22
    frame23 = b"\0\0\0\6" + bytes(6) + b"TIT2\0\0\0\6\0\0\0World"
    v23 = b"ID3\3\0\x40" + mpeg_audio._safe(len(frame23)) + frame23
    frame24 = b"\0\0\0\6\1\0" + b"TPE1\0\0\0\4\0\0\3Who"
    v24 = b"ID3\4\0\x40" + mpeg_audio._safe(len(frame24)) + frame24
    got = mpeg_audio.read_audio(v22 + v23 + v24 + audio + old)
    assert got["frames"] == 3 and got["skipped"] == 0
    assert got["tags"] == {"TT2": "Hello", "TIT2": "World", "TPE1": "Who", "ID3v1:title": "Title", "ID3v1:artist": "Artist", "ID3v1:album": "Album", "ID3v1:year": "1999", "ID3v1:comment": "note", "ID3v1:track": "7", "ID3v1:genre": "17"}


def test_media_table():
    m = mpeg_audio.write_audio(b"a" * 6400)
    r = mpeg_audio.read_audio(m)
    assert r["table_matches"] and len(r["vbr"]["toc"]) == 100 and r["vbr"]["kind"] == "Xing"
    assert mpeg_audio.read_audio(m[: r["offsets"][-1]])["table_matches"] is False
    at = m.index(b"Xing") + 8 + 4 + 4 + 100 + 4
    lame = m[:at] + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big") + m[at + 24 :]
    assert mpeg_audio.read_audio(lame)["samples"] == r["samples"] - 1576


def test_media_headers():
    assert mpeg_audio.header(bytes((0xFF, 0xFB, 0x90, 0x00)))[:4] == (417, 1152, 44100, 128)  # MPEG-1 Layer III
    assert mpeg_audio.header(bytes((0xFF, 0xFD, 0x80, 0x00)))[:4] == (417, 1152, 44100, 128)  # MPEG-1 Layer II
    assert mpeg_audio.header(bytes((0xFF, 0xF3, 0x80, 0x00)))[:4] == (208, 576, 22050, 64)  # MPEG-2 Layer III
    assert mpeg_audio.header(bytes((0xFF, 0xEB, 0x90, 0x00))) is None


def test_media_query(spark, tmp_path):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 50_000), (5, "abc")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in mpeg_audio.op5_media_columns(spark, str(tmp_path)).collect()}
    for i, t in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (64 if not b else 0))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[1]["feature"] == got[5]["feature"] and got[1]["media_sha256"] == got[5]["media_sha256"]


def judged(url, rules, weights):
    host, path = url_filters.split_url(url)
    fits = [(len(r), len(h), v, r) for v, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        return max(fits)[3], max(fits)[2]
    f = url_filters.features(host, path)
    z = weights[f].sum() / np.sqrt(max(1, len(f))) + weights[-1]
    return None, "block" if 1 / (1 + np.exp(-z)) >= 0.5 else "allow"


def test_urls(spark, tmp_path):
    urls = ["https://A.Example.ORG/es/1", "http://example.org/en/12", "https://example.org/en/2", "https://org", "x://org/", "https://x.com/fr/1?q", "https://com/de/", "https://xcom/de/", None, "", "no-scheme.org/", "https://casino-win.example.net/en/1", "https://notes.example.net#/fr", "https://b.example.com?x=/fr/", "mailto://é.org/é\n/?"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    w = url_filters.fit()
    for r in url_filters.op8_url_filters(spark, str(tmp_path)).collect():
        url = urls[r["page_id"]]
        assert (r["host"], r["path"]) == url_filters.split_url(url)
        assert (r["rule"], r["verdict"]) == judged(url, url_filters.RULES, w)
    assert judged("https://casino-win.example.net/en/1", url_filters.RULES, w)[1] == "block" and judged("https://en.wikipedia.org/wiki/Otter", (), w)[1] == "allow"
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string"), w).isEmpty()


def test_held_out_matches_crc(spark):
    from riskweave.llm.base import is_held_out

    df = spark.range(500).select(F.col("id").alias("doc_id"), is_held_out(F.col("id")).alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in df.collect())
