"""Properties of the row-level helpers on generated texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import bpe, decontaminate, html_extract, language_id, quality_rules, simhash, suffix_dedup
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_quality_rules import plain as measures
from tests.llm.test_simhash import plain_fingerprint

texts = st.one_of(st.text(max_size=300), st.text(alphabet="ab \n\tAé1#|.'<>/&;\x1c\x85\xa0", max_size=400), st.lists(st.sampled_from(["the", "The", "a", "is,", "x-y", "é"]), max_size=80).map(" ".join))
few = settings(max_examples=150, deadline=None)


@pytest.fixture(scope="module")
def both():
    path = bpe.public_vocabulary()
    return bpe.Encoder(bpe.Vocabulary(open(path, encoding="utf-8").read())), Tokenizer.from_file(path)


@few
@given(st.lists(texts, max_size=5))
def test_bpe_is_the_library(both, some):
    encoder, library = both
    for t, ids in zip(some, encoder.encode(some)):
        assert ids == library.encode(t, add_special_tokens=False).ids and bpe.decode(encoder.vocab, ids) == t


@few
@given(texts)
def test_measures_are_those_of_the_rules(t):
    x = quality_rules.Text(t)
    assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == measures(t)
    assert x.n_letters == sum(map(str.isalpha, t))


@few
@given(texts)
def test_fingerprints(t):
    assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


@few
@given(texts, st.lists(texts, max_size=4))
def test_windows_of_items(t, items):
    numbered = [(str(i), x) for i, x in enumerate(items)]
    own = decontaminate.words(t)
    found, ranges = decontaminate.Machine(numbered).scan(own)
    want = next(hits([t], numbered))
    assert len(own) == want[0] and len(found) == want[2] and sum(b - a for a, b in decontaminate._union(ranges)) == want[1]
    assert len(own) == len(decontaminate._WORD.findall(t))


@few
@given(st.one_of(texts, st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "a b", "<b", "&amp", "<!--", "-->", "<script>", "</script>", "<a href='x'>", "</a>", "<li>", "<br>", "<td", "'>"]), max_size=40).map("".join)))
def test_any_markup_is_read(page):
    found, marks = html_extract.blocks(page)
    for b in found:
        assert b.text == " ".join(html_extract._split(b.text)) and b.text and 0 <= b.density <= 1 and b.main < len(marks) and b.chrome < len(marks)
    assert html_extract.features(found, marks).shape == (len(found), len(html_extract.FEATURES))


@few
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 30)), min_size=1, max_size=12))
def test_merged_intervals(pairs):
    s, e = np.array([a for a, _ in pairs]), np.array([a + n for a, n in pairs])
    covered = sorted({x for a, b in zip(s, e) for x in range(a, b)})
    runs = suffix_dedup.merged(s, e)
    assert [x for a, b in runs for x in range(a, b)] == covered
    assert all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))


@few
@given(texts)
def test_language_n_grams(t):
    one, two, three = language_id.n_grams(t)
    assert len(one) and one.min() >= 0 and all((np.diff(x) > 0).all() for x in (one, two, three))
    assert set(one.tolist()) - {0} == {ord(c) for c in t.lower() if c.isalpha()}
