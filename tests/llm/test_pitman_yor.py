"""Seating against brute force, and predictive probabilities as a distribution."""

import itertools
import math

import numpy as np
import pytest

from ledgerlens.llm import pitman_yor as hpy
from ledgerlens.llm.hashing import U, mix


def partitions_by_tables(n, discount):
    """Weights of all seatings of ``n`` customers by number of tables, customer by customer."""
    ways = {(1,): 1.0}
    for _ in range(n - 1):
        after = {}
        for sizes, weight in ways.items():
            for i, s in enumerate(sizes):
                key = tuple(sorted((*sizes[:i], s + 1, *sizes[i + 1 :])))
                after[key] = after.get(key, 0) + weight * (s - discount)
            key = tuple(sorted((*sizes, 1)))
            after[key] = after.get(key, 0) + weight
        ways = after
    out = [0.0] * (n + 1)
    for sizes, weight in ways.items():
        out[len(sizes)] += weight
    return out


@pytest.mark.parametrize("discount", [0.1, 0.5, 0.8])
def test_stirling_numbers_count_seatings(discount):
    for n in range(1, 9):
        assert np.allclose(np.exp(hpy.log_stirling(discount)[n, 1 : n + 1]), partitions_by_tables(n, discount)[1:])


def exact(c, pull, discount):
    logs = np.full(c + 1, -np.inf)
    logs[1] = 0
    for n in range(1, c):
        t = np.arange(0, c + 1)
        stay = np.where(t <= n, logs + np.log(np.maximum(n - discount * t, 1e-300)), -np.inf)
        logs = np.logaddexp(stay, np.concatenate(([-np.inf], logs[:-1])))
    w = logs + np.arange(c + 1) * math.log(pull)
    w = np.exp(w - w[1:].max())
    w[0] = 0
    return w / w.sum()


@pytest.mark.parametrize(("c", "pull", "discount"), [(2, 0.3, 0.5), (7, 1.5, 0.7), (40, 0.2, 0.4), (128, 3.0, 0.6)])
def test_draws_follow_the_exact_conditional(c, pull, discount):
    n = 20_000
    u = hpy.uniform(mix(np.arange(n, dtype=U)), 3)
    t = hpy.draw(np.full(n, c), np.full(n, pull), discount, u)
    assert 0.5 * np.abs(np.bincount(t, minlength=c + 1) / n - exact(c, pull, discount)).sum() < 0.03


def test_error_of_the_limit():
    """Total variation of the Poisson limit just past EXACT: what the approximation costs."""
    c = hpy.EXACT + 1
    for discount, pull in itertools.product([0.4, 0.6, 0.8], [0.01, 0.1, 0.5]):
        m = pull / discount
        k = np.arange(c)
        limit = np.exp(k * np.log(m) - m - np.array([math.lgamma(x + 1) for x in k]))
        assert 0.5 * np.abs(limit - exact(c, pull, discount)[1:]).sum() < 0.05, (discount, pull)


def test_poisson_quantiles():
    u = (np.arange(20_000) + 0.5) / 20_000
    for mean in (0.01, 2.0, 59.0, 61.0, 5_000.0):
        x = hpy.poisson(np.full(len(u), mean), u)
        assert x.mean() == pytest.approx(mean, rel=0.01) and x.var() == pytest.approx(mean, rel=0.03)


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(1)
    words, contexts = 30, 4
    word, context = (x.ravel() for x in np.meshgrid(np.arange(words), np.arange(contexts), indexing="ij"))
    count = rng.poisson(2, len(word))
    names, keys = hpy.word_keys(np.arange(words, dtype=U)), hpy.pair_keys(word.astype(U), context.astype(U))
    customers, tables, root_tables = np.bincount(context, count), np.minimum(count, 1), None
    for sweep in range(3):
        of_root, of_context = np.bincount(word, tables), np.bincount(context, tables)
        root_tables = np.minimum(of_root, 1) if root_tables is None else stage.root_seats(of_root, names, sweep)
        stage = hpy.Stage(float(of_root.sum()), float(root_tables.sum()), (0.6, 0.4), words, int(count.sum()))
        root = stage.root(of_root, root_tables)
        unknown = stage.new_word() / (hpy.STRENGTH + stage.root_customers)
        assert root.sum() + unknown == pytest.approx(1)
        last = stage.predictive(count, tables, root[word], customers[context], of_context[context])
        for c in range(contexts):
            never = stage.predictive(0, 0, unknown, customers[c], of_context[c])
            assert last[context == c].sum() + never == pytest.approx(1)
        tables = stage.seats(count, root[word], of_context[context], keys, sweep + 1)
        assert (tables <= count).all() and (tables[count > 0] > 0).all()
