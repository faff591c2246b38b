"""One very long text, of the kinds that make careless code slow or large: each takes time in proportion to its length."""

import random
import time

import brute
import numpy as np
import pytest

from millrace.llm import html, licenses, media, packing, pii

MILLION = 1_000_000


def seconds(function, *given):
    began = time.perf_counter()
    out = function(*given)
    return out, time.perf_counter() - began


@pytest.mark.parametrize("text", ["1" * MILLION, "1." * (MILLION // 2), "a@" * (MILLION // 2), "a" * MILLION + "@" + "b" * MILLION, "+1(" * (MILLION // 3), "1 " * (MILLION // 2)])
def test_base_patterns_of_long_texts(text):
    assert seconds(pii.base_spans, text)[1] < 5


def test_addresses_begin_where_digits_do():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choices(["1", "25", "256", ".", ".", "a", "00"], k=r.randrange(40)))
        assert [f"ip:{a}:{b}" for a, b in pii.base_spans(text)["ip"]] == [x for x in brute.base_spans(text) if x.startswith("ip")], text


@pytest.mark.parametrize("text", [" " * (2 * MILLION), "a" + "\n" * (2 * MILLION) + "b", "x" * MILLION, "9" * MILLION, " \t" * 30_000 + "end"])
def test_ids_of_long_texts_equal_the_named_tokenizer(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    assert packing.Encoder(path).ids(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [b"SPDX-License-Identifier: MIT " * 40_000, b"License-Expression: " + b"MIT OR " * 150_000, b"License-Expression: " + b" OR ".join(b"x%d" % i for i in range(50_000)), b"License-Expression: " + b"(" * 300_000])
def test_many_licence_tags(text):
    assert seconds(licenses.scan, licenses.automaton(), text)[1] < 10


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<p>x" * 100_000, "<li>x" * 100_000, "<b>x" * 100_000, "<a " * 100_000, '<a "' * 100_000, "<a '\"" * 100_000, "<!-- " * 100_000, "<nav>" * 100_000, "<div class=ad>" * 50_000 + "x", "<script>" * 100_000, "<![CDATA[" * 50_000, "</p>" * 100_000, "<" * 300_000, "<table><tr><td>x" * 30_000, "x</b>" * 100_000])
def test_deep_and_broken_pages(page):
    found, took = seconds(html.blocks, page)
    path, more = seconds(lambda: html.best_path(html.scores(found)))
    text, last = seconds(html.text_at, found, path)
    assert took + more + last < 15 and (text is None or len(text) <= 2 * len(page) + 2)


def test_deep_boxes():
    data = b""
    for _ in range(3000):
        data = media.box(b"udta", data)
    out, took = seconds(media.describe, data)
    assert out["error"] == "ValueError: no tracks" and took < 5


def fragment(moof_first, samples, keys, track=1):
    """A moof box and its mdat, by hand: sizes and flags for each sample."""
    body = b"".join(samples)
    entries = b"".join(np.array([10, len(s), 0 if k else 0x10000], ">u4").tobytes() for s, k in zip(samples, keys, strict=True))

    def moof(offset):
        run = media.full(b"trun", len(samples).to_bytes(4, "big"), offset.to_bytes(4, "big"), entries, flags=0x701)
        return media.box(b"moof", media.full(b"mfhd", bytes(4)), media.box(b"traf", media.full(b"tfhd", track.to_bytes(4, "big"), flags=0x20000), run))

    return moof(len(moof(0)) + 8) + media.box(b"mdat", body)


def test_fragmented_media():
    head = media.mux(bytes(64))
    r = random.Random(2)
    first, second = [[r.randbytes(r.randrange(1, 50)) for _ in range(n)] for n in (5, 3)]
    data = head + fragment(True, first, [True, False, False, True, False]) + fragment(False, second, [False, True, False])
    info = media.describe(data)
    track = info["tracks"][0]
    assert info["error"] is None and track["n_samples"] == 9 and track["sample_bytes"] == 64 + sum(map(len, first + second))
    assert media.demux(data) == bytes(64) + b"".join(first + second)
    assert [data[k["first"] : k["end"]] for k in track["keyframes"]] == [bytes(64), first[0], first[3], second[1]]
    assert "does not have" in media.describe(head + fragment(True, first, [True] * 5, track=9))["error"]
    rng = random.Random(3)
    for _ in range(400):
        broken = bytearray(data)
        for _ in range(rng.randrange(1, 4)):
            broken[rng.randrange(len(head), len(broken))] = rng.randrange(256)
        out = media.describe(bytes(broken))
        assert out["error"] is None or out["tracks"] == []


def test_files_without_tracks_have_a_reason():
    assert media.describe(media.box(b"moov"))["error"] == "ValueError: no tracks" == media.describe(media.box(b"ftyp", b"isom", bytes(4)))["error"]
