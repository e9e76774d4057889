"""Density clusters of one group in plain Python: every pair of points sorted, and the merge tree walked from its root; and the preparation of its vectors."""

import numpy as np


def clusters(x: np.ndarray, least: int, k: int) -> tuple[list[int], list[float]]:
    """(smallest member of each point's cluster, -1 for noise; strength)."""
    n = len(x)
    if n < 2 * least:
        return [-1] * n, [0.0] * n
    d = np.zeros((n, n))
    for j in range(x.shape[1]):
        d += np.square(x[:, j, None] - x[None, :, j])
    d = np.sqrt(d)
    near = d + np.diag(np.full(n, np.inf))
    core = np.sort(near, axis=1)[:, min(k, n - 1) - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    a, b = np.triu_indices(n, 1)
    up, name, size, kids, height = list(range(n)), list(range(n)), {i: 1 for i in range(n)}, {}, {}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for p in np.lexsort((b, a, w[a, b])).tolist():
        i, j = find(int(a[p])), find(int(b[p]))
        if i != j:
            new = n + len(kids)
            kids[new], height[new], size[new] = (name[i], name[j]), w[a[p], b[p]], size[name[i]] + size[name[j]]
            up[j], name[i] = i, new
    root = n + len(kids) - 1

    def leaves(i):
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += kids[j]
        return out

    born, points, below, todo = {root: 0.0}, {root: []}, {root: []}, [(root, root)]
    while todo:
        i, c = todo.pop()
        lam = 1 / max(height[i], 1e-12)
        big = [q for q in kids[i] if size[q] >= least]
        for q in kids[i]:
            if len(big) == 2:
                born[q], points[q], below[q] = lam, [], []
                below[c].append((q, lam))
                todo.append((q, q))
            elif q in big:
                todo.append((q, c))
            else:
                points[c] += [(p, lam) for p in leaves(q)]
    mass = {c: sum(lam - born[c] for _, lam in points[c]) + sum((lam - born[c]) * size[q] for q, lam in below[c]) for c in born}
    total, chosen = {}, {}
    for c in reversed(list(born)):  # children after parents in born
        under = sum(total[q] for q, _ in below[c])
        chosen[c] = c != root and mass[c] >= under
        total[c] = max(mass[c], under)
    label, strength, todo = [-1] * n, [0.0] * n, [root]
    while todo:
        c = todo.pop()
        if not chosen[c]:
            todo += [q for q, _ in below[c]]
            continue
        inside, stack = [], [c]
        while stack:
            q = stack.pop()
            inside += points[q]
            stack += [j for j, _ in below[q]]
        first, most = min(p for p, _ in inside), max(lam for _, lam in inside)
        for p, lam in inside:
            label[p], strength[p] = first, min(1.0, lam / most)
    return label, strength


def yeo_johnson(x: np.ndarray, lam: float) -> np.ndarray:
    """The power transform of one variable."""
    out = np.empty_like(x, dtype=float)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-9 else (np.power(x[pos] + 1, lam) - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-9 else -(np.power(1 - x[~pos], 2 - lam) - 1) / (2 - lam)
    return out


def yeo_johnson_lambda(x: np.ndarray, low: float = -2.0, high: float = 4.0, rounds: int = 60) -> float:
    """The exponent of the largest normal likelihood, by golden-section search; 1 (no change) for a constant."""
    if x.std() < 1e-12:
        return 1.0
    jacobian = (np.sign(x) * np.log1p(np.abs(x))).sum()

    def loss(lam: float) -> float:
        return len(x) / 2 * np.log(max(yeo_johnson(x, lam).var(), 1e-300)) - (lam - 1) * jacobian

    g = (5**0.5 - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    for _ in range(rounds):
        if loss(c) < loss(d):
            b, d = d, c
            c = b - g * (b - a)
        else:
            a, c = c, d
            d = a + g * (b - a)
    return (a + b) / 2


def prepare(x: np.ndarray) -> np.ndarray:
    """Stable dimensions only, scaled by median and interquartile range, power-transformed and standardised; NaN and infinities are 0."""
    x = np.nan_to_num(x.astype(float), nan=0.0, posinf=0.0, neginf=0.0)
    q1, q2, q3 = np.percentile(x, [25, 50, 75], axis=0)
    keep = (x.var(axis=0) > 1e-6) & (q3 - q1 > 1e-6)
    x = (x[:, keep] - q2[keep]) / (q3 - q1)[keep]
    for j in range(x.shape[1]):
        x[:, j] = yeo_johnson(x[:, j], yeo_johnson_lambda(x[:, j]))
    return (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)


def principal(x: np.ndarray, k: int) -> np.ndarray:
    """The first k principal components; x itself where it has no more dimensions."""
    if k >= x.shape[1]:
        return x
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return u[:, :k] * s[:k]
