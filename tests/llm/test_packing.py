import itertools
import random

import pytest

from skillgrid.llm import packing as PK
from skillgrid.llm.queries import QUERIES
from skillgrid.llm.tokens import Tokenizer

from .conftest import ODD, SF


def total(bins, capacities, overhead, attention):
    """Cost of bins (lists of lengths), each cut down to its contents."""
    return sum(PK.cost(min(c for c in capacities if c >= sum(held)), overhead, attention) for held in bins)


def slow_fit(lengths, mix, capacities, overhead, attention):
    """One mix by the rules, trying every open bin for every piece and forecasting piece by piece."""
    bins = []
    for i, n in enumerate(lengths):
        open_ = [(cap - sum(held), -last, b) for b, (cap, held, last) in enumerate(bins) if cap - sum(held) >= n]
        if open_:
            b = min(open_)[2]
            bins[b][1].append(n)
            bins[b][2] = i
            continue
        rated = []
        for cap in capacities:
            if cap >= n and (cap in mix or not any(c >= n for c in mix)):
                held = 0
                for m in lengths[lengths.index(n):]:
                    held += m if held + m <= cap else 0
                rated.append((total([[held]], capacities, overhead, attention) / held, cap))
        cap = min(rated)[1] if any(c >= n for c in mix) else min(c for _, c in rated)
        bins.append([cap, [n], i])
    return [held for _, held, _ in bins]


def optimum(lengths, capacities, overhead, attention):
    """Least cost over all ways to split the pieces into bins."""
    n = len(lengths)
    weight = [sum(x for i, x in enumerate(lengths) if m >> i & 1) for m in range(1 << n)]
    least = [0] * (1 << n)
    for m in range(1, 1 << n):
        low, sub, options = m & -m, m, []
        while sub:
            if sub & low and weight[sub] <= max(capacities):
                options.append(total([[weight[sub]]], capacities, overhead, attention) + least[m ^ sub])
            sub = (sub - 1) & m
        least[m] = min(options)
    return least[-1]


def random_case(seed, most):
    rng = random.Random(seed)
    caps = tuple(rng.sample([8, 12, 16, 24, 32], rng.randint(1, 4)))
    longest = rng.randint(1, max(caps))
    lengths = sorted((rng.randint(1, longest) for _ in range(rng.randint(0, most))), reverse=True)
    return lengths, caps, rng.choice([0, 2, 8]), rng.choice([4, 32, 1000])


def bins_of(lengths, places):
    bins = {}
    for n, (b, at) in zip(lengths, places):
        assert at == sum(bins.setdefault(b, []))
        bins[b].append(n)
    return [bins[b] for b in sorted(bins)]


@pytest.mark.parametrize("seed", range(40))
def test_against_every_bin_and_mix(seed):
    lengths, caps, overhead, attention = random_case(seed, 60)
    places, final = PK.best_fit(lengths, caps, overhead, attention)
    mixes = [m for k in range(1, len(caps) + 1) for m in itertools.combinations(sorted(caps), k)]
    ways = [slow_fit(lengths, m, sorted(caps), overhead, attention) for m in mixes]
    want = min(ways, key=lambda w: total(w, caps, overhead, attention))
    assert bins_of(lengths, places) == want
    assert final == [min(c for c in caps if c >= sum(held)) for held in want]


def test_against_the_optimum_and_single_capacities():
    """Never under the exhaustive optimum, on average within 2 % of it, and never over any single capacity's cost."""
    ratios = []
    for seed in range(150):
        lengths, caps, overhead, attention = random_case(seed, 8)
        if not lengths:
            continue
        mine = total(bins_of(lengths, PK.best_fit(lengths, caps, overhead, attention)[0]), caps, overhead, attention)
        for c in caps:
            assert mine <= total(slow_fit(lengths, (c,), sorted(caps), overhead, attention), caps, overhead, attention)
        ratios.append(mine / optimum(lengths, caps, overhead, attention))
    assert min(ratios) >= 1 and max(ratios) <= 1.3 and sum(ratios) / len(ratios) <= 1.02


def test_capacities_compete():
    """Pieces a little over half of the smallest bin go in twos and more into larger ones, tiny ones into the smallest."""
    rng = random.Random(3)
    half = sorted((rng.randint(260, 400) for _ in range(1000)), reverse=True)
    tiny = sorted((rng.randint(1, 50) for _ in range(1000)), reverse=True)
    medium = sorted((rng.randint(200, 1500) for _ in range(1000)), reverse=True)
    assert set(PK.best_fit(tiny, PK.CAPACITIES, 32)[1]) == {512}
    assert 512 not in PK.best_fit(half, PK.CAPACITIES, 32)[1]
    assert len(set(PK.best_fit(medium, PK.CAPACITIES, 32)[1])) > 1
    single = [total(slow_fit(half[::2], (c,), PK.CAPACITIES, 32, PK.ATTENTION), PK.CAPACITIES, 32, PK.ATTENTION) for c in PK.CAPACITIES]
    mine = sum(PK.cost(c) for c in PK.best_fit(half[::2], PK.CAPACITIES, 32)[1])
    assert mine < 0.98 * min(single)


def check(rows, docs, tokenizer, caps):
    want = {}
    for d, t in docs:
        want.setdefault(d, []).append(tokenizer.count(t))
    got, bins = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.n_tokens))
        if r.n_tokens == 0:
            assert r.bin_id is None
        else:
            bins.setdefault((r.bin_id, r.capacity), []).append((r.position, r.n_tokens))
    for d, counts in want.items():
        assert sum(n for _, _, n in got[d]) == sum(counts)
        if len(counts) == 1:
            at = 0
            for k, (piece, first, n) in enumerate(sorted(got[d])):
                assert (piece, first) == (k, at)
                at += n
    assert set(got) == set(want) and len({b for b, _ in bins}) == len(bins)
    for (_, cap), held in bins.items():
        at = 0
        for position, n in sorted(held):
            assert position == at
            at += n
        assert at <= cap and cap == min(c for c in caps if c >= at)
    return bins


def test_query(spark, documents):
    rows = QUERIES["op10_best_fit_packing"](spark, SF).collect()
    bins = check(rows, documents, Tokenizer("x"), PK.CAPACITIES)
    assert sum(n for held in bins.values() for _, n in held) > 0.95 * sum(cap for _, cap in bins)


def test_many_groups_and_odd_rows(spark, odd_docs, no_docs):
    t = Tokenizer("x")
    rows = PK.pack(PK.pieces(odd_docs, t, 64), (16, 32, 64), 4, group=3).collect()
    check(rows, ODD, t, (16, 32, 64))
    assert PK.packed_documents(no_docs).collect() == []
