"""The lattices that are walked side by side give the ids of the public library, whatever the limits are."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loomwatch.llm import pieces


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Encoder(pieces.Vocabulary.read(pieces.MODEL))


def odd_texts():
    r = random.Random(7)
    out = [None, "", " ", "▁", "a▁b", " " * 900 + "b", "a" * 3000, "ab" * 700, "日本語" * 900, "😀" * 300, "tion" * 400, "\x00\n\t"]
    out += ["".join(r.choice("abcdeiou  \n▁-_ü日😀") for _ in range(r.randrange(400))) for _ in range(60)]
    return out + ["".join(r.choice("the and ing tion er ") for _ in range(3000)), "".join(r.choice("=-#*") for _ in range(800))]


@pytest.mark.parametrize(("size", "lanes"), [(1 << 19, 16), (300, 0), (300, 1), (40, 5), (1 << 19, 0), (1, 16)])
def test_ids_equal_the_library(both, monkeypatch, size, lanes):
    sp, e = both
    monkeypatch.setattr(pieces, "SLICE", size)
    monkeypatch.setattr(pieces, "LANES", lanes)
    texts = odd_texts()
    ids, sizes, restored = e.encode_all(texts)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    for i, t in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == sp.encode(t or ""), (i, (t or "")[:40])
        assert restored[i] == ("▁" not in (t or "")) == (e.decode(ids[cuts[i] : cuts[i + 1]]) == (t or ""))


def test_long_lanes_commit_before_they_end(both, monkeypatch):
    sp, e = both
    monkeypatch.setattr(pieces, "LANES", 0)
    committed = []
    plain = pieces.Lanes._commit
    monkeypatch.setattr(pieces.Lanes, "_commit", lambda self, rows, to: (committed.append(bool((to < self.size[rows]).any())), plain(self, rows, to)))
    text = "internationalization" * 40
    assert e.encode(text).tolist() == sp.encode(text)
    assert sum(committed) > 10  # long before the one lane's end


def test_lanes_whose_paths_do_not_meet_are_walked_alone(both, monkeypatch):
    sp, e = both
    monkeypatch.setattr(pieces.Lanes, "_meet", lambda self, rows, k: self.done[rows])
    monkeypatch.setattr(pieces, "LANES", 0)
    for t in odd_texts():
        assert e.encode(t or "").tolist() == sp.encode(t or "")


@pytest.mark.parametrize(("wide", "step", "many"), [(256, 128, 0), (20, 16, 0), (8, 4, 0), (8, 32, 0)])
def test_long_parts_in_stretches(both, monkeypatch, wide, step, many):
    sp, e = both
    for name, value in (("WIDE", wide), ("STEP", step), ("MANY", many)):
        monkeypatch.setattr(pieces, name, value)
    r = random.Random(9)
    texts = odd_texts() + ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABC+/=0123") for _ in range(6000)), "".join(chr(r.randrange(0x4E00, 0x5200)) for _ in range(3000)), "a" * 5000, "é" * 700, "internationalization" * 90]
    ids, sizes, restored = e.encode_all(texts)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    for i, t in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == sp.encode(t or ""), (i, (t or "")[:40])
        assert restored[i] == ("▁" not in (t or ""))


def test_texts_without_spaces_are_not_walked_alone(both, monkeypatch):
    sp, e = both
    r = random.Random(10)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000)), "".join(chr(r.randrange(0x4E00, 0x5200)) for _ in range(20_000))]
    monkeypatch.setattr(pieces.Encoder, "_lattice", lambda self, text: 1 / 0)
    ids, sizes, _ = e.encode_all(texts)
    assert ids.tolist() == [i for t in texts for i in sp.encode(t)]


def test_lookup():
    keys = [k * k * k + 7 * k for k in range(5000)]
    found = pieces.Lookup(keys[:4000], list(range(4000)))
    assert found.get(np.array(keys)).tolist() == list(range(4000)) + [-1] * 1000
    assert pieces.Lookup([], []).get(np.array([3, 4])).tolist() == [-1, -1]
