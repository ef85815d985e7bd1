"""Telephony audio, web archives, token files: round trips and brute force."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import odd_rows, words
from oracle import connect
from pyspark.sql import functions as F

from aislewise.llm import telephony as T
from aislewise.llm import tokenstore as S
from aislewise.llm import warc as W
from aislewise.llm.bpe import encoder
from aislewise.llm.common import stored


def test_companding_tables():
    mu, a = T.expansion(T.MULAW), T.expansion(T.ALAW)
    assert (mu[0xFF], mu[0x00], mu[0x80], mu[0x7F]) == (0, -32124, 32124, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(np.unique(mu)) == 255 and len(np.unique(a)) == 256


def adpcm_by_sample(block: bytes) -> list[int]:
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = T.STEP_SIZES[index]
            change = step // 8 + (step // 4 if code & 1 else 0) + (step // 2 if code & 2 else 0) + (step if code & 4 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(T.INDEX_STEPS[code])))
            out.append(value)
    return out


def test_adpcm_blocks_equal_sample_by_sample():
    raw = random.Random(3).randbytes(64 * 40)
    blocks = np.frombuffer(raw, np.uint8).reshape(-1, 64)
    assert T.decode_adpcm(blocks).tolist() == [adpcm_by_sample(raw[i : i + 64]) for i in range(0, len(raw), 64)]


@pytest.mark.parametrize("target", [1000, 8000, 11025, 16000])
def test_resampled_tone_keeps_its_shape(target):
    tone = (8000 * np.sin(2 * np.pi * 100 * np.arange(8000) / 8000)).astype(np.int16)
    out = T.resample(tone, 8000, target)
    want = 8000 * np.sin(2 * np.pi * 100 * np.arange(len(out)) / target)
    assert len(out) == target
    assert np.abs(out - want)[20:-20].max() < (200 if target >= 8000 else 600)


def test_wav_round_trip():
    for codec in (*T.CODECS, T.PCM):
        assert T.unwav(T.wav(codec, b"ab" * 64, 16000)) == (codec, 16000, b"ab" * 64)


def test_telephony_rows(odd, empty):
    got = T.telephony(odd).toPandas()
    assert len(got) == len(odd_rows())
    by_text = {}
    for doc, text, _ in odd_rows():
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        hit = got[(got.n_bytes == len(raw)) & (got.payload_sha256 == hashlib.sha256(payload).hexdigest())]
        hit = hit[hit.doc_id.isna() if doc is None else hit.doc_id == doc]
        assert len(hit) >= 1
        row = hit.iloc[0]
        assert (row.payload_bytes, row.tail_crc32) == (len(payload), zlib.crc32(payload[-64:]))
        assert row.media_bytes > len(payload)
        same = (row.media_sha256, row.feature)
        assert by_text.setdefault(payload, same) == same
    assert T.telephony(empty).count() == 0


def test_tracks_keep_the_whole_band(odd):
    """The query's tracks have 16,000 samples a second, at least those of the source."""
    for row in T.telephony(odd).toPandas().itertuples():
        codec, rate, n = (int(v) for v in row.feature.split("/")[:3])
        samples = row.payload_bytes // T.BLOCK * T.PER_BLOCK if codec == T.ADPCM else row.payload_bytes
        assert (rate, n) == (16000, 2 * samples)


def test_layered_tracks_are_lossless():
    """Any track of its core's length comes back bit by bit, whatever the core says of it."""
    rng = np.random.default_rng(3)
    for codec in T.CODECS:
        payload = rng.integers(0, 256, 640, np.uint8).tobytes()
        core = T.to_pcm([(codec, 8000, payload)])[0]
        right = T.resample(core, 8000, 16000)
        noise = rng.integers(-32768, 32768, len(right)).astype(np.int16)
        nearly = right.copy()
        nearly[::97] -= 3
        files = [T.layered(codec, 8000, payload, core, t, 16000) for t in (right, noise, nearly)]
        for (rate, got), want in zip(T.unlayered(files), (right, noise, nearly), strict=True):
            assert rate == 16000 and got.dtype == np.int16 and np.array_equal(got, want)
        assert T.unwav(files[1]) == (codec, 8000, payload)


def test_stored_tracks_take_little_room(spark):
    """Media and whole tracks together take little more than the texts, compressed alike."""
    df = spark.createDataFrame([(k, words(k, 900)) for k in range(60)], "doc_id long, text string").coalesce(1)
    size = lambda t: sum(os.path.getsize(f.removeprefix("file://")) for f in t.inputFiles())
    plain, media = stored(df, "texts"), T.store_media(df, 8000, 16000)
    assert size(media) < 1.5 * size(plain)
    tracks = T.unlayered([r.files[1] for r in media.collect()])
    assert sum(len(t) for _, t in tracks) >= 2 * sum(len(r.text) for r in df.collect())


def test_packed_tracks_are_lossless():
    """Any tracks come back bit by bit, of odd length, empty, clipped, of few values or many, and each alone."""
    rng = np.random.default_rng(4)
    loud = np.repeat(np.array([-32768, 32767, -32768], np.int16), 301)
    noise = rng.integers(-32768, 32768, 5001).astype(np.int16)
    tone = T.resample((9000 * np.sin(np.arange(4000) / 7)).astype(np.int16), 8000, 16000)
    for tracks in ([tone, noise], [loud], [np.empty(0, np.int16), loud[:1], tone[:2]], [np.zeros(9, np.int16)], [tone[:300]]):
        for file, want in zip(T.pack_tracks(tracks, 16000), tracks, strict=True):
            rate, got = T.unpack_track(file)
            assert rate == 16000 and got.dtype == np.int16 and np.array_equal(got, want)
    assert len(T.pack_tracks([tone], 16000)[0]) < 0.8 * tone.nbytes
    with pytest.raises(ValueError):
        T.unpack_track(T.wav(T.PCM, tone.tobytes(), 16000))


def test_stored_tracks_are_whole_without_their_media(spark, odd):
    """The query's table holds every track: it comes back from its own bytes when all media and the resampler are gone."""
    table = T.store_tracks(odd, 8000, 16000)
    want = {}
    for _, text, _ in odd_rows():
        payload = T.payload_of((text or "").encode())
        codec = T.CODECS[zlib.crc32(payload) % len(T.CODECS)]
        want[T.wav(codec, payload)] = T.resample(T.to_pcm([(codec, 8000, payload)])[0], 8000, 16000)
    rows = table.collect()
    assert len(rows) == len(odd_rows()) and {bytes(r.media) for r in rows} == set(want)
    for r in rows:
        rate, got = T.unpack_track(bytes(r.track))
        assert rate == 16000 and np.array_equal(got, want[bytes(r.media)])
        assert b"data" not in r.track[:64] and len(got) <= len(r.track)  # no core in it, and a byte a sample at least
    noise = T.media_digests(table.withColumn("media", F.lit(T.wav(T.MULAW, b"other" * 64)))).toPandas()
    same = T.media_digests(table).toPandas()
    cut = lambda d: sorted(f.split("/", 1)[1] for f in d.feature)
    assert cut(noise) == cut(same)


def test_loser_tree_merges_in_order():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(50), i, j) for j in range(rng.randrange(30))) for i in range(k)]
        got = list(W.LoserTree([iter([(x, x) for x in r]) for r in runs]))
        assert [g[0] for g in got] == sorted(x for r in runs for x in r)


def odd_pages():
    long = "<p>" + "é" * 90_000 + "</p>"
    return [
        (1, "http://B.example.com:80/x?q=1#f", "<a>"), (2, "https://a.example.com/", "<a>"), (3, None, None), (4, "", ""),
        (5, "http://user@c.org", long), (9, "nonsense \r\n url", long), (7, "http://a.example.com/y", "one\r\n\r\nWARC/1.1\r\n\r\n"),
        (None, "http://n.org/", "<a>"), (None, "http://n.org/", "alone"), (6, "http://dup.org/", "dup"), (6, "http://dup.org/", "dup"),
        (8, "http://a.example.com/y", "x\r\n\r\n"),
    ]


@pytest.mark.parametrize("least", [0, 4])
def test_archives_equal_brute_force(spark, least):
    rows = odd_pages()
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha1 string").repartition(3)
    got = W.archive_pages(pages, least).toPandas()
    winner = {}
    for page, _, html in rows:
        key = -1 if page is None else page
        winner[html or ""] = max(winner.get(html or "", -2), key)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        top = winner[html or ""]
        later = len(raw) >= least and top != (-1 if page is None else page)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((page, len(raw), digest, "revisit" if later else "response", top if later else None))
    none = lambda v: None if v != v or v is None else int(v)
    have = [(none(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, none(r.refers_to)) for r in got.itertuples()]
    assert sorted(have, key=str) == sorted(want, key=str)
    ordered = got.sort_values("position")
    assert ordered.position.tolist() == list(range(len(rows)))
    keys = list(zip(ordered.url_key, ordered.ts, strict=True))
    assert keys == sorted(keys)
    assert W.archive_pages(pages.limit(0)).count() == 0


def test_archives_do_not_depend_on_parts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    path = W.write_archives(pages)
    one = W.histories(W.merge_runs(W.read_archives(spark, path), 1)).select("position", "page_id").toPandas()
    many = W.histories(W.merge_runs(W.read_archives(spark, path), 7)).select("position", "page_id").toPandas()
    order = lambda d: d.sort_values("position").page_id.tolist()
    assert order(one) == order(many)


def test_perfect_hash_is_minimal_and_round_trips():
    keys = S.key_hash(np.arange(-500, 4500), np.zeros(5000, np.int64))
    perfect = S.PerfectHash.from_bytes(S.PerfectHash.build(keys).to_bytes())
    assert sorted(perfect.slots(keys).tolist()) == list(range(5000))
    assert S.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_text(name):
    tok = encoder(public_tokenizers.path(name))
    texts = [t or "" for _, t, _ in odd_rows()] + ["  a  b", "a \n b\n\n c   d", "it's don't 0 00 a0b", "trail ", "  x", "Σ ΟΔΟΣ é"]
    assert tok.encode(texts) == [tok.whole(t).tobytes() for t in texts]
    assert tok.encode(texts) == [tok.whole(t).tobytes() for t in texts]


def test_token_store_equals_brute_force(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = S.token_store(odd, path, 2).toPandas()
    tok = encoder(path)
    rows = sorted(((d if d is not None else -(1 << 63), t or "") for d, t, _ in odd_rows()))
    start, want = 0, []
    for doc, text in rows:
        ids = np.append(tok.whole(text), 2).astype("<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    have = [(-(1 << 63) if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got.itertuples()]
    assert sorted(have) == sorted(want)
    assert S.token_store(empty, path, 2).count() == 0


def test_unknown_keys_are_not_found(spark, odd):
    segments = S.write_segments(odd, public_tokenizers.path("word_bpe_49k.json"), 2)
    index = S.build_index(S.places(segments), 3)
    asked = spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.lit(0).alias("copy"))
    assert S.look_up(index, asked, 3).count() == 0


def test_pages_sql_is_registered():
    from __spark_entry__ import oracle_sql

    sql = oracle_sql()["op2_warc"]
    assert connect("/root/testdata/sf0.001").execute(sql).fetchall()
