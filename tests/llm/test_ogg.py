import hashlib
import random
import zlib

import pytest

from pelagos.llm import ogg


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else (crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_against_bitwise_division():
    data = bytes(random.Random(1).randrange(256) for _ in range(300))
    assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 9_999, 10_001, 130_000, 400_001])
def test_round_trip(n):
    payload, size = ogg.pad("é" * (n // 2) + "x" * (n % 2))
    media = ogg.write_ogg(payload, size)
    back = ogg.read_recording(media)
    assert back.payload == payload and back.n_bytes == size == n and back.duration_us == len(payload) // 2 * 125
    assert len(back.ogg.streams) == 2 and not back.ogg.bad_pages


def test_damage_is_found_and_the_rest_is_read():
    payload, size = ogg.pad("x" * 300_000)
    media = bytearray(ogg.write_ogg(payload, size))
    media[len(media) // 2] ^= 1
    back = ogg.read_recording(bytes(media))
    assert back.payload is None and back.ogg.bad_pages == 1 and back.ogg.gaps == 1 and sum(s.lost for s in back.ogg.streams.values()) >= 1
    assert sum(len(s.packets) for s in back.ogg.streams.values()) > 4


def test_junk_between_pages_and_lost_first_page():
    payload, size = ogg.pad("y" * 20_000)
    media = ogg.write_ogg(payload, size)
    second = media.find(b"OggS", 4)
    assert ogg.read_recording(b"junk" + media[:second] + b"OggSjunk" + media[second:]).ogg.pages == ogg.read_ogg(media).pages
    assert ogg.read_recording(media[second:]).payload is None


def test_packet_of_whole_lacing_values_ends_with_zero():
    pages = ogg.stream_pages(9, [(b"h", 0), (b"a" * 510, 510)], headers=1)
    got = ogg.read_ogg(b"".join(p for _, p in pages)).streams[9]
    assert got.packets == [b"h", b"a" * 510] and got.ends == [0, 510] and got.closed


def test_granules_count_back_between_pages():
    s = ogg.Stream(1, [b"a" * 3, b"b" * 4, b"c" * 5], [-1, -1, 12])
    assert ogg.packet_ends(s, [3, 4, 5]) == [3, 7, 12]


def test_column(messy, empty):
    df = ogg.decode_column(ogg.encode_column(messy("payload"))).select("doc_id", "text", "payload", "n_bytes", "payload_sha256", "tail_crc32", "media_sha256", "media")
    rows = df.collect()
    assert len(rows) == 10
    for r in rows:
        payload, size = ogg.pad(r.text)
        assert bytes(r.payload) == payload and r.n_bytes == size and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
    assert len({r.media_sha256 for r in rows if r.text and r.text.startswith("The")}) == 1
    assert ogg.decode_column(ogg.encode_column(empty)).count() == 0


def test_feature_from_the_text_alone(messy):
    """Packets, length and the signal's figures from the padded text, without a look into the file."""
    for r in ogg.decode_column(ogg.encode_column(messy())).select("text", "feature", "n_packets", "duration_us", "n_streams", "lost_packets").collect():
        raw = (r.text or "").encode()
        raw += b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        x = [b - 128 for b in raw]
        packets = 2 * (2 + -(-len(raw) // 2 // 5000))
        us = len(raw) // 2 * 1_000_000 // 8000
        want = f"packets={packets};us={us};peak={max(map(abs, x))};sum={sum(x)};energy={sum(v * v for v in x)};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))}"
        assert (r.feature, r.n_packets, r.duration_us, r.n_streams, r.lost_packets) == (want, packets, us, 2, 0)


def test_null_media(spark):
    r = ogg.decode_column(spark.createDataFrame([(None,), (bytearray(),)], "media binary")).collect()
    assert [(x.payload, x.n_pages) for x in r] == [(None, 0), (None, 0)]
