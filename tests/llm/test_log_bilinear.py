"""A step of noise-contrastive estimation against plain dense gradients; one model for the tasks of a worker."""

import numpy as np

from quantspark.llm import log_bilinear as lb


def test_step_against_dense_gradients():
    rng, n, k = np.random.default_rng(5), 60, 300
    unigram = rng.random(n) ** 3 + 1e-4
    unigram /= unigram.sum()
    log, cdf = np.log(unigram).astype(np.float32), np.cumsum(unigram)
    cdf[-1] = 1.0
    got, want = lb.LogBilinear.start(unigram), [x.astype(np.float64) for x in vars(lb.LogBilinear.start(unigram)).values() if x is not None]
    state, held = [np.zeros_like(x) for x in (got.r, got.q, got.b, got.c)], [np.zeros_like(x) for x in want]
    for seed in range(3):
        context, word, weight = rng.integers(0, 40, (k, lb.CONTEXT)), rng.integers(0, 50, k), rng.integers(1, 4, k).astype(np.float32)
        got.learn(context.astype(np.int32), word.astype(np.int32), weight, log, cdf, np.random.default_rng(seed), state)
        noise = np.searchsorted(cdf, np.random.default_rng(seed).random(lb.NOISE))
        r, q, b, c = want
        g = [np.zeros_like(x) for x in want]
        h = sum(r[context[:, i]] * c[i] for i in range(lb.CONTEXT))
        gh = np.zeros_like(h)
        for j in range(k):
            for w, sign in [(word[j], 1.0), *((x, -1.0) for x in noise)]:
                s = h[j] @ q[w] + b[w] - log[w] - np.log(lb.NOISE)
                e = sign * weight[j] / (1 + np.exp(sign * s))
                g[1][w] += e * h[j]
                g[2][w] += e
                gh[j] += e * q[w]
            for i in range(lb.CONTEXT):
                g[0][context[j, i]] += gh[j] * c[i]
                g[3][i] += gh[j] * r[context[j, i]]
        for x, y, s in zip(want, g, held, strict=True):
            y /= np.sqrt(k)
            s += y * y
            x += lb.RATE * y / np.sqrt(s + 1e-6)
    for x, y in zip((got.r, got.q, got.b, got.c), want, strict=True):
        assert np.allclose(x, y, atol=2e-3)


def test_tasks_of_a_worker_share_normalisers():
    params, n = lb.LogBilinear.start(np.full(20, 0.05)).dump(), 20
    first = lb._model(params, n)
    first.log10(np.arange(12, dtype=np.int32))
    other = lb._model(bytes(bytearray(params)), n)
    assert other is first and np.isfinite(other._norm).sum() == 10
