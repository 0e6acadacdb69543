"""O(n^2) reference computations from the definitions (small inputs only)."""

import numpy as np


def digamma(x):
    x = np.asarray(x, dtype=float)
    z = x + 6.0
    sh = sum(1.0 / (x + i) for i in range(6))
    z2 = z * z
    return np.log(z) - 0.5 / z - 1 / 12 / z2 + 1 / 120 / z2 ** 2 - 1 / 252 / z2 ** 3 + 1 / 240 / z2 ** 4 - sh


def avg_rank(v):
    v = np.asarray(v)
    order = np.argsort(v, kind="mergesort")
    ranks = np.empty(len(v))
    sv = v[order]
    i = 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and sv[j + 1] == sv[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2.0 + 1
        i = j + 1
    return ranks


def mi_cd(x, d, k=3):
    n = len(x)
    radius = np.zeros(n)
    lc = np.zeros(n)
    ka = np.zeros(n)
    for lab in np.unique(d):
        m = d == lab
        c = m.sum()
        if c > 1:
            kk = min(k, c - 1)
            xs = x[m]
            r = np.empty(c)
            for i in range(c):
                dd = np.abs(xs - xs[i])
                dd[i] = np.inf
                r[i] = np.partition(dd, kk - 1)[kk - 1]
            radius[m] = np.nextafter(r, 0)
            ka[m] = kk
        lc[m] = c
    m = lc > 1
    xm, rm = x[m], radius[m]
    cnt = np.array([(np.abs(xm - xm[i]) <= rm[i]).sum() for i in range(len(xm))])
    mi = digamma(m.sum()) + digamma(ka[m]).mean() - digamma(lc[m]).mean() - digamma(cnt).mean()
    return max(0.0, mi)


def mi_cc(x, y, k=3):
    n = len(x)
    nx = np.empty(n)
    ny = np.empty(n)
    for i in range(n):
        d = np.maximum(np.abs(x - x[i]), np.abs(y - y[i]))
        d[i] = np.inf
        r = np.nextafter(np.partition(d, k - 1)[k - 1], 0)
        nx[i] = (np.abs(x - x[i]) <= r).sum() - 1
        ny[i] = (np.abs(y - y[i]) <= r).sum() - 1
    mi = digamma(n) + digamma(k) - np.mean(digamma(nx + 1)) - np.mean(digamma(ny + 1))
    return max(0.0, mi)


def dcor(x, y):
    a = np.abs(x[:, None] - x[None, :])
    b = np.abs(y[:, None] - y[None, :])
    A = a - a.mean(0)[None, :] - a.mean(1)[:, None] + a.mean()
    B = b - b.mean(0)[None, :] - b.mean(1)[:, None] + b.mean()
    v = (A * A).mean() * (B * B).mean()
    return float(np.sqrt((A * B).mean() / np.sqrt(v))) if v > 0 else 0.0


def auc(labels, scores):
    r = avg_rank(scores)
    p = labels == 1
    P, N = p.sum(), (~p).sum()
    return (r[p].sum() - P * (P + 1) / 2) / (P * N)
