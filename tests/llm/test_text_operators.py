import base64
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from pacegrid.llm import bpe, chat, ogg

PATH = public_tokenizers.path(bpe.RANKS)


def plain_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENC = plain_encoding()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab Ç1\n\t '.é٣中 ́s", max_size=120), st.integers(2, 9))
def test_safe_parts_keep_ids(text, size):
    assert bpe.encode_text(bpe.encoding(PATH), text, size) == ENC.encode_ordinary(text)
    assert "".join(p for p, _ in bpe.safe_parts(text, size)) == text


def test_runs_without_boundary():
    for text in ("a" * 5000, " " * 3000 + "x", "12" * 2000 + "!" * 3000):
        assert bpe.encode_text(bpe.encoding(PATH), text, 64) == ENC.encode_ordinary(text)


def test_bpe_rows(docs, empty):
    rows = bpe.encode(docs, PATH, fields=("n_tokens", "token_ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(rows) == docs.count()
    for r, d in zip(rows, docs.collect(), strict=True):
        text = d.text or ""
        assert r.token_ids == ENC.encode_ordinary(text) and r.n_tokens == len(r.token_ids)
        assert bytes(r.decoded) == text.encode() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.token_ids)).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert [bytes(b.decoded) for b in back] == [(d.text or "").encode() for d in docs.collect()]
    assert bpe.encode(empty, PATH).count() == 0


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        crc &= 0xFFFFFFFF
    return crc


def test_ogg_checksum_and_round_trip():
    rng = random.Random(3)
    for n in (0, 1, 255, 256, 4096, 65025, 70000, 300_000):
        data = rng.randbytes(n)
        assert n > 5000 or ogg.checksum(data) == slow_crc(data)
        payload = ogg.payload_of(data)
        assert len(payload) % 64 == 0 and payload and payload.startswith(data)
        back, facts = ogg.load(ogg.store(payload))
        assert back == payload and facts["times"][-1] == len(payload) / ogg.RATE


def test_ogg_long_packets_cross_pages():
    packets = [ogg.Packet(b"head", 0), ogg.Packet(bytes(510), 5), ogg.Packet(b"x" * 200_000, 9), ogg.Packet(b"", 9)]
    found = ogg.demux(ogg.mux([ogg.Stream(7, packets), ogg.Stream(8, packets[:2])]))
    assert [p.data for p in found[7].packets] == [p.data for p in packets] and found[7].packets[-1].granule == 9
    assert [p.data for p in found[8].packets] == [p.data for p in packets[:2]]


def test_ogg_damage_is_found():
    media = bytearray(ogg.store(ogg.payload_of(b"abc" * 500)))
    media[len(media) // 2] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.demux(bytes(media))
    with pytest.raises(ogg.OggError):
        ogg.demux(bytes(ogg.store(ogg.payload_of(b"abc")))[:-3])


def test_media_rows(docs, empty):
    for r, d in zip(ogg.media_features(docs).collect(), docs.collect(), strict=True):
        payload = ogg.payload_of((d.text or "").encode())
        assert (r.n_bytes, r.payload_bytes) == (len((d.text or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
    assert ogg.media_features(empty).count() == 0


TRICKY = st.lists(st.sampled_from(["\\", "<s>", "</s>", "[INST]", "[/INST]", "[SAY]", "[ROLE]", "[/ROLE]", " ", "a", "[", "/", "\n", ""]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "x [/ROLE]"]), TRICKY), max_size=5))
def test_chat_round_trip(turns):
    found = chat.render_incrementally(chat.default_template, turns)
    assert chat.parse(found["formatted"]) == turns and not found["rewrites"]
    assert [chat.unescape(found["formatted"][a:b]) for a, b in found["texts"]] == [t for _, t in turns]
    assert found["spans"] == [] or found["spans"][-1][1] == len(found["formatted"])


def test_every_private_character_in_a_text():
    text = "".join(map(chr, chat.PROBES)) + f"{chr(chat.PROBES[0])}0{chr(chat.PROBES[-1])}"
    found = chat.render_incrementally(chat.default_template, [("assistant", text), ("user", "x"), ("assistant", text)])
    assert [found["formatted"][a:b] for a, b in found["texts"]] == [text, "x", text]


def test_many_turns():
    turns = [("assistant" if i % 2 else "user", f"turn {i} </s>" * 3) for i in range(300)]
    found = chat.render_incrementally(chat.default_template, turns)
    assert chat.parse(found["formatted"]) == turns and None not in found["texts"] and not found["rewrites"]


def test_rewriting_template_is_found():
    template = lambda turns: "|".join(t for _, t in turns[-2:])
    assert chat.render_incrementally(template, [("user", "abc"), ("assistant", "d"), ("user", "e")])["rewrites"] == [2]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, "late"), (2, 3, "assistant", "x"), (None, 0, "assistant", "n")]
    found = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1].turns_sha256 == sha("user\n\nuser\n\nassistant\nb\n") and found[1].loss_sha256 == sha("b")
    assert found[2].turns_sha256 == sha("assistant\nx\n\nlate\n") and found[None].loss_chars == 1
    at = found[1].loss_mask[0]
    assert found[1].formatted[at.start : at.end] == "b" and found[1].formatted_chars == len(found[1].formatted)
    assert re.search("b", found[1].formatted)


def test_conversation_edges(spark):
    schema = "conv_id long, turn long, role string, text string, id string, label string"
    rows = [(-7, 0, "user", None, "x", "y"), (-7, 1, "assistant", "".join(map(chr, chat.PROBES)), None, None)] + [(5, i, "assistant", None if i % 3 else "t", "", "") for i in range(60)]
    found = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert found[-7].loss_chars == len(chat.PROBES) and found[5].n_turns == 60 and found[5].loss_chars == 20
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0
    quoting = lambda turns: "|".join(f"{t}/{len(t)}" for _, t in turns)
    back = lambda s: [("assistant", x) for x in s.split("|")]
    with pytest.raises(Exception, match="no loss mask"):
        chat.format_conversations(spark.createDataFrame([(1, 0, "assistant", "twelve chars")], "conv_id long, turn long, role string, text string"), quoting, back, str).collect()


def test_query_keeps_a_conversation_of_the_same_id_apart(spark, tmp_path):
    spark.createDataFrame([(-7, 0, "assistant", "mine")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = chat.op8_chat_formatting(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.n_turns, r.loss_chars) for r in found) == [(-7, 1, 4), (-7, 2, 21)]
