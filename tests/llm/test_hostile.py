"""Long and hostile texts: the same results as the plain rule, in bounded time."""

import random
import re
import time

import pytest

from tallyfolio.llm import langid, lengths

_HIDDEN = re.compile(rb"<(script|style|nav|template)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_DECLARED = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)


def test_pages_against_the_plain_patterns():
    rng = random.Random(2)
    parts = [b"<!--", b"-->", b"<script", b"</script >", b"</SCRIPT>", b"<Style>", b"</style>", b"<nav>", b"</nav", b">", b"<", b"<html", b" lang=", b"'en'", b'"de"', b"fr "]
    parts += [b"<htmlx", b"text", b"&amp;", b"<template>", b"</template>", b" ", b"lang = es", b"<scripty>", b"-", b"<p>"]
    for _ in range(5000):
        page = b"".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        plain = _HIDDEN.sub(b" ", page)
        assert langid.visible(page) == re.sub(rb"&#?[A-Za-z0-9]{1,10};", b" ", re.sub(rb"<[^>]*>", b" ", plain))
        found = _DECLARED.search(plain)
        assert langid.declared(page) == (found[1].decode().lower() if found else "")


@pytest.mark.parametrize("part", [b"<!--", b"<script>", b"<html ", b"<", b"<html lang ", b"</script ", b"<nav></nav>", b"<script></style>"])
def test_pages_of_two_megabytes(part):
    began = time.perf_counter()
    page = part * (2_000_000 // len(part))
    langid.visible(page), langid.declared(page)
    assert time.perf_counter() - began < 20


def test_lengths_with_runs_of_space(monkeypatch):
    rng = random.Random(1)
    code = lengths.encoder(lengths.VOCABULARY)
    monkeypatch.setattr(lengths, "LONG", 4)
    monkeypatch.setattr(lengths, "_LONG_SPACE", re.compile(r"\s{4,}"))
    for _ in range(5000):
        text = "".join(rng.choice([" ", "  ", "\n", "\t", "　", " ", "a", "B", "1", "!", "'s", "é", " x"]) * rng.randrange(1, 6) for _ in range(rng.randrange(12)))
        assert lengths.length_of(text) == len(code.encode_ordinary(text)), text


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "　" * 700_000, "a" + " " * 1_000_000 + "b", "é" * 1_000_000])
def test_lengths_of_two_megabytes(text):
    began = time.perf_counter()
    assert lengths.length_of(text) > 0
    assert time.perf_counter() - began < 30
