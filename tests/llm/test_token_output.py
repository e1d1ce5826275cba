import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from alembiq.llm import seekable
from alembiq.llm import token_output as T

SCHEMA = "doc_id long, text string, start string, path string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", " ", "a", "Ab", "é", "\n", "\t", "\x85", "\xa0", "\x1c", "12", "'s", "!!", "ß", "<|endoftext|>", "漢", "　"]), max_size=14).map("".join))
def test_pieces_equal_whole_texts(text):
    enc = T.encoder(T.vocabulary())
    assert np.frombuffer(enc.encode(pa.array([text, 'a b']))[0], enc.dtype).tolist() == enc.lib.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, library, tmp_path):
    r = random.Random(4)
    words = ["the", "cat", "naïve", "x1", "\n", "", "zz,"]
    rows = [(i * 3 - 20, " ".join(r.choice(words) for _ in range(r.randint(0, 50))), "s", None) for i in range(200)]
    rows += [(7, None, None, None), (7, "", None, None), (None, "no id", None, None), (10**9, "long " * 300_000, None, None), (1, "dup", None, None), (1, "dup", None, None)]
    manifest = T.write_shards(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}", shards=3)
    got = T.read_shards(spark, manifest).orderBy("start").collect()
    want, start = [], 0
    for d, t in sorted(((d, t or "") for d, t, *_ in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1].encode())):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(x) for x in got] == want
    shard = T.ShardReader(manifest[0]["path"])
    assert [x.tolist() for x in shard.find(1)][1] == [*library.encode("dup", add_special_tokens=False).ids, 2]


def test_empty_table(spark, tmp_path):
    manifest = T.write_shards(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}")
    assert manifest == [] and T.read_shards(spark, manifest).count() == 0


def test_damaged_frames_are_noticed(tmp_path):
    uri = f"file://{tmp_path}/a.zst"
    w = seekable.Writer(uri)
    for i in range(5):
        w.frame(bytes([i]) * 1000)
    w.close(b"index")
    r = seekable.Reader(uri)
    assert r.index() == b"index" and r.frame(3) == b"\x03" * 1000
    raw = bytearray((tmp_path / "a.zst").read_bytes())
    at = r.starts[2] + r.entries[2][0] - 3
    raw[at] ^= 0xFF
    (tmp_path / "a.zst").write_bytes(bytes(raw))
    bad = seekable.Reader(uri)
    assert bad.frame(1) == b"\x01" * 1000
    with pytest.raises(Exception):  # noqa: B017  zstandard or we notice, by where the damage is
        bad.frame(2)


def test_plain_decoders_read_the_frames(tmp_path):
    import io

    import zstandard

    uri = f"file://{tmp_path}/b.zst"
    w = seekable.Writer(uri)
    w.frame(b"one")
    w.frame(b"two")
    w.close(b"")
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / "b.zst").read_bytes()), read_across_frames=True) as f:
        assert f.read() == b"onetwo"


def test_a_worker_remembers_little(library, monkeypatch):
    """Pieces are forgotten beyond the bound, long ones at once, and nothing is left after a task; the ids stay the library's."""
    monkeypatch.setattr(T, "REMEMBERED", 50 * T.PIECE_BYTES)
    enc = T.Encoder(T.vocabulary())
    r = random.Random(1)
    for _ in range(20):
        texts = ["a " + " ".join("".join(r.choice("abcdé") for _ in range(r.choice([3, 5, 90]))) + r.choice(["", ",", "."]) for _ in range(30)) for _ in range(3)]
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.known) <= 50 + 180 and max(map(len, enc.known)) <= T.LONGEST
    enc.forget()
    assert not enc.known and not enc.older and not enc.held


def test_texts_are_encoded_in_groups(monkeypatch):
    monkeypatch.setattr(T, "GROUP_BYTES", 10)
    texts = ["abc", "", "defgh", "ij", "k" * 25, "l", "m"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(a, b)), "text": texts[a:b]}) for a, b in ((0, 2), (2, 3), (3, 7))]
    groups = list(T._groups(iter(batches)))
    assert [x for g in groups for x in g.column("text").to_pylist()] == texts and [g.num_rows for g in groups] == [4, 1, 2]


def test_white_space_is_pythons():
    """Pieces that begin with white space are told by Arrow, not one by one, and are those that Python tells."""
    signs = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    assert [c for c, found in zip(signs, T.pc.match_substring_regex(pa.array(signs), T._BLANK).to_pylist()) if found] == [c for c in signs if c.isspace()]
    assert not any(T.pc.match_substring_regex(pa.array(["", "a b", "a\n"]), T._BLANK).to_pylist())
