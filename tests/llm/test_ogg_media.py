import hashlib
import random
import zlib

import pytest

from weftgraph.llm import ogg_media as O


def test_checksum_bit_by_bit():
    def slow(data):
        c = 0
        for x in data:
            c ^= x << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c

    rng = random.Random(1)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert O.page_checksum(data) == slow(data)


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 1919, 1920, 1921, 3840, 65025, 200_001])
@pytest.mark.parametrize("streams", [1, 2, 3])
def test_round_trip(size, streams):
    payload = random.Random(size).randbytes(size)
    media = O.write_ogg(payload, streams)
    back, info = O.read_ogg(media)
    assert back == payload and info["damaged"] == 0 and info["streams"] == streams and info["ended"] == streams
    assert info["samples"] == size


def test_packets_across_pages_and_exact_lacing():
    payload = bytes(range(255)) * 700
    for packet in (255, 510, 254, 100_000):
        back, info = O.read_ogg(O.write_ogg(payload, 2, packet))
        assert back == payload and info["packets"] == -(-len(payload) // packet)


def test_damage_is_seen_and_left_out():
    payload = random.Random(5).randbytes(400_000)
    media = bytearray(O.write_ogg(payload))
    media[150_000] ^= 1
    back, info = O.read_ogg(bytes(media))
    assert info["damaged"] >= 1 and len(back) < len(payload)
    assert all(back[i : i + 192] in payload for i in range(0, 1920, 192))
    cut, info = O.read_ogg(bytes(media[:1000]))
    assert info["damaged"] == 1 and cut == b""


def test_query(spark, awkward, nothing, folder):
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    rows = O.op9_ogg_media(spark, folder(documents=awkward)).collect()
    assert len(rows) == 13
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        media = O.write_ogg(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["feature"] == by[7]["feature"] and by[6]["media_sha256"] == by[7]["media_sha256"]
    assert O.op9_ogg_media(spark, folder(documents=nothing)).collect() == []
