"""Properties of the pure parts, over generated inputs."""

import numpy as np
from hypothesis import given, settings, strategies as st

from strandline.llm import chat, decontam, licenses, mixing, pii, simhash

words = st.lists(st.integers(0, 3), min_size=0, max_size=40)


@given(words, words, st.integers(1, 14))
def test_shared_spans_have_equal_fingerprints(a, b, span):
    hashes = lambda w: (np.array(w, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x, y = decontam.winnow(hashes(a), span), decontam.winnow(hashes(b), span)
    assert len(x) == max(0, len(a) - span + 1)
    for i in range(len(x)):
        for j in range(len(y)):
            if a[i : i + span] == b[j : j + span]:
                assert x[i] == y[j]


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_pigeonring_keys_meet(fp, flips):
    other = fp
    for bit in flips:
        other ^= 1 << bit
    seg = lambda v, i: v >> simhash.WIDTH * (i % simhash.SEGMENTS) & (1 << simhash.WIDTH) - 1
    assert any(seg(fp, i) == seg(other, i) and seg(fp, i + far) == seg(other, i + far) for i in range(simhash.SEGMENTS) for far in (1, 2))


@given(st.text(st.sampled_from("a1.@+- ()é\n%_x2"), max_size=60))
def test_pii_spans_are_in_range_and_mask_undoes_nothing_else(text):
    spans, failed = pii.base_spans(text)
    assert all(0 <= a < b <= len(text) for _, a, b in spans) and all(0 <= a < len(text) for a in failed)
    for kind in pii.KINDS:
        own = [(a, b) for k, a, b in spans if k == kind]
        assert own == sorted(own) and all(x[1] <= y[0] for x, y in zip(own, own[1:]))
    assert pii.mask(text, "") == text


@settings(max_examples=60)
@given(st.lists(st.tuples(st.integers(1, 400), st.floats(0.01, 0.99)), min_size=1, max_size=60), st.integers(0, 99))
def test_landing_closes_all_units_near_the_total(units, seed):
    size, p = np.array([u[0] for u in units], float), np.array([u[1] for u in units])
    flown = mixing.flight(p, size, np.random.default_rng(seed))
    landed = mixing.land(flown, size)
    assert set(landed.tolist()) <= {0.0, 1.0}
    assert abs((landed * size).sum() - (p * size).sum()) <= size.max() + 1e-6


@given(st.lists(st.sampled_from([chat.SYSTEM, chat.USER, chat.ASSISTANT, None]), max_size=12), st.integers(0, 12))
def test_split_runs_choose_the_same_repairs(roles, at):
    costs = chat.back_over(roles, chat.END_COST)
    whole = chat.choose(roles, costs, chat.START)
    at = min(at, len(roles))
    head = chat.choose(roles[:at], chat.back_over(roles[:at], costs[at]), chat.START)
    state = head[-1][1] if head else chat.START
    assert head + chat.choose(roles[at:], costs[at:], state) == whole


@given(st.lists(st.sampled_from(sorted({w for _, t in licenses.TEMPLATES for w in t.lower().split()}) + ["x", "y"]), max_size=25), st.integers(0, 5))
def test_filters_lose_no_template(block, seed):
    own = [w for w in licenses.alnum_words(" ".join(block))]
    frequency = {w: (hash((w, seed)) % 7) for w in own}
    join = licenses.Join(licenses.TEMPLATES, frequency, licenses.THRESHOLD)
    want = sorted((label, len(t & set(own)) / len(t)) for label, t in join.sets if len(t & set(own)) >= licenses.THRESHOLD * len(t) - 1e-9)
    assert sorted(join.matches(own)) == want
