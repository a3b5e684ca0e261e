"""Graphical lasso along a path of penalties: exact screening into components, warm starts, Newton steps on the covariance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


class Components:
    """Union-find over columns. Columns i, j are in one component at a penalty where a chain of |s| above it joins them
    (Witten, Friedman and Simon 2011): the precision has no entry between components. Falling penalties only join them."""

    def __init__(self, s: np.ndarray):
        i, j = np.triu_indices(len(s), 1)
        order = np.argsort(-np.abs(s[i, j]), kind="stable")
        self.i, self.j, self.size = i[order].tolist(), j[order].tolist(), np.abs(s[i, j])[order]
        self.up, self.next = list(range(len(s))), 0

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def at(self, alpha: float) -> list[np.ndarray]:
        """The components at a penalty, which may not exceed that of the call before."""
        until = int(np.searchsorted(-self.size, -alpha, side="left"))
        for k in range(self.next, until):
            a, b = self.root(self.i[k]), self.root(self.j[k])
            self.up[max(a, b)] = min(a, b)
        self.next = max(self.next, until)
        roots = np.array([self.root(k) for k in range(len(self.up))])
        return [np.flatnonzero(roots == r) for r in np.unique(roots)]


def one_at_a_time(w: np.ndarray, s: np.ndarray, alpha: float, b: np.ndarray, free: np.ndarray, tol: float) -> np.ndarray:
    """argmin of b'Wb/2 - s'b + alpha |b|_1 over the columns `free`, by feature-sign search (Lee et al. 2007) from b.

    The active columns' equations are solved with their signs held; on the way there a column whose
    sign would turn stops at zero and leaves. At the optimum of the set the column with the largest gradient beyond alpha joins.
    Every step lowers the objective, so no set comes twice.
    """
    b, signs = b.copy(), np.sign(b)
    for _ in range(20 * len(s)):
        while len(on := np.flatnonzero(signs)):
            x = np.linalg.solve(w[np.ix_(on, on)], s[on] - alpha * signs[on])
            turns = np.flatnonzero(x * signs[on] < 0)
            if not len(turns):
                b[on] = x
                break
            share = b[on][turns] / (b[on][turns] - x[turns])
            first = turns[np.argmin(share)]
            b[on] += share.min() * (x - b[on])
            b[on[first]] = signs[on[first]] = 0.0
        g = s - w[:, on] @ b[on]
        beyond = np.where(free & (signs == 0), np.abs(g) - alpha, -1.0)
        best = int(np.argmax(beyond))
        if beyond[best] <= tol * alpha:
            break
        signs[best] = np.sign(g[best])
    return b


def row(w: np.ndarray, s: np.ndarray, alpha: float, b: np.ndarray, free: np.ndarray, tol: float, tries: int = 12) -> np.ndarray:
    """The same minimum over the columns `free` of the whole w, s, b, by active sets.

    Active are the columns that coordinate descent would leave other than zero; their equations are
    solved as one system, until the set and its signs repeat, which is the exact optimum. Where they do not within `tries`
    rounds, the set changes by one column at a time.
    """
    diag = w.diagonal()
    before, start = None, b
    for _ in range(tries):
        on = np.flatnonzero(b)
        u = s - w[:, on] @ b[on] + diag * b
        active = np.flatnonzero((np.abs(u) > alpha) & free)
        signs = np.sign(u[active])
        if before is not None and len(before[0]) == len(active) and (before[0] == active).all() and (before[1] == signs).all():
            return b
        before, b = (active, signs), np.zeros(len(s))
        if len(active):
            b[active] = np.linalg.solve(w[np.ix_(active, active)], s[active] - alpha * signs)
    return one_at_a_time(w, s, alpha, start, free, tol)


def block(s: np.ndarray, alpha: float, w: np.ndarray, betas: np.ndarray, max_iter: int, tol: float, enet_tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, precision) of one component by block coordinate descent (Friedman, Hastie and Tibshirani 2008) from a
    start w, betas; betas are changed in place. At most max_iter sweeps, until the covariance moves by less than tol of the mean |s|."""
    p = len(s)
    off = ~np.eye(p, dtype=bool)
    w, least = w.copy(), tol * max(np.abs(s[off]).mean(), 1e-300)
    for _ in range(max_iter):
        moved = 0.0
        for j in range(p):
            free = off[j]
            b = betas[j] = row(w, s[j], alpha, betas[j], free, enet_tol)
            on = np.flatnonzero(b)
            new = w[:, on] @ b[on]
            new[j] = w[j, j]
            moved += np.abs(new - w[j]).sum()
            w[j] = w[:, j] = new
        if moved / (p * p) < least:
            break
    theta = np.zeros_like(s)
    for j in range(p):
        theta[j] = -betas[j]
        theta[j, j] = 1.0
        theta[j] /= max(w[j, j] - w[j] @ betas[j], 1e-12)
    return w, (theta + theta.T) / 2


#: Entries of the covariance within this share of the penalty from their bound lie on it.
EDGE = 1e-9
#: Precision of an entry that should be zero, as a share of its scale: up to this a component counts as solved.
SOLVED = 1e-9


def newton(s: np.ndarray, alpha: float, w: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(covariance, precision) of one component from a positive definite start within alpha of s, None where the steps do not settle.

    The covariance maximises log det w with |w - s| <= alpha off the diagonal (Banerjee, El Ghaoui and d'Aspremont 2008). Entries on their
    bound stay there while the precision, which is the gradient, has the bound's sign; the others take a Newton step by
    conjugate gradients (two products of p x p matrices each, the inverse of w in the Hessian), cut at the bounds and halved until log det
    grows. Few steps settle where descent by rows takes a sweep of p systems of equations for each digit or so. At most
    max_iter steps, until the covariance moves by less than tol of the mean |s|.
    """
    p = len(s)
    still = np.eye(p, dtype=bool)
    low, high, least = s - alpha, s + alpha, tol * max(np.abs(s[~still]).mean(), 1e-300)
    low[still] = high[still] = s.diagonal()
    w = np.where(high - w < EDGE * alpha, high, np.where(w - low < EDGE * alpha, low, w))
    try:
        value = 2 * np.log(np.linalg.cholesky(w).diagonal()).sum()
        theta, moved = inverse(w), np.inf
        for step in range(max_iter + 1):
            free = ~(still | ((w >= high) & (theta > 0)) | ((w <= low) & (theta < 0)))
            size = np.outer(theta.diagonal(), theta.diagonal()) + theta * theta  # the Hessian's diagonal
            gradient = theta * free
            left = np.abs(gradient / np.sqrt(size)).max()
            if moved < least or left < 1e-13 or step == max_iter:
                break
            to = conjugate(theta, gradient, free, size)
            share = 1.0
            for _ in range(40):
                at = np.minimum(np.maximum(w + share * to, low), high)
                try:
                    got = 2 * np.log(np.linalg.cholesky(at).diagonal()).sum()
                    if got >= value + 1e-4 * (gradient * (at - w)).sum() or abs(got - value) < 1e-13 * abs(value):
                        break
                except np.linalg.LinAlgError:  # too far
                    pass
                share /= 2
            else:
                return None
            moved, w, value = np.abs(at - w).sum() / (p * p), at, got
            theta = inverse(w)
    except np.linalg.LinAlgError:
        return None
    return (w, np.where(free & ~still, 0.0, theta)) if left <= SOLVED else None


def inverse(w: np.ndarray) -> np.ndarray:
    theta = np.linalg.inv(w)
    return (theta + theta.T) / 2


def conjugate(theta: np.ndarray, gradient: np.ndarray, free: np.ndarray, size: np.ndarray) -> np.ndarray:
    """x with theta x theta = gradient on the free entries and 0 elsewhere, by conjugate gradients scaled by the diagonal; the nearer the optimum, the closer."""
    free, scale = free.astype(float), 1 / size
    x, left, half, image = np.zeros_like(gradient), gradient.copy(), np.empty_like(gradient), np.empty_like(gradient)
    z = left * scale
    to, now = z.copy(), np.vdot(left, z)
    enough = max(1e-4 * now * min(1.0, now), 1e-28)
    for _ in range(8 * len(theta)):
        np.matmul(np.matmul(theta, to, out=half), theta, out=image)
        image *= free
        share = now / np.vdot(to, image)
        x += np.multiply(to, share, out=half)
        left -= np.multiply(image, share, out=half)
        np.multiply(left, scale, out=z)
        after = np.vdot(left, z)
        if after <= enough:
            break
        to *= after / now
        to += z
        now = after
    return x


def betas_of(theta: np.ndarray) -> np.ndarray:
    """Each column's regression on the others, a row each, that a precision stands for."""
    out = -theta / theta.diagonal()[:, None]
    np.fill_diagonal(out, 0.0)
    return out


def path(s: np.ndarray, alphas: Sequence[float], max_iter: int = 100, tol: float = 1e-7, enet_tol: float = 1e-6) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in alphas, covariance, precision) for each penalty, from the largest down; off-diagonal entries are penalised.

    Components are solved by themselves, by Newton steps, or by descent over rows (enet_tol) where these do not settle. A
    component starts from what its parts had at the penalty before: w = t w' + (1 - t) s with t = alpha / alpha' keeps |w - s| within alpha and w positive definite. Penalty 0 gives
    the covariance and its pseudo-inverse.
    """
    p = len(s)
    diag = np.diag(s.diagonal())
    w, theta, above = diag, np.diag(1 / np.maximum(s.diagonal(), 1e-12)), max(np.abs(s - diag).max(initial=0.0), 1e-300)
    found = Components(s)
    for k in sorted(range(len(alphas)), key=lambda k: -alphas[k]):
        alpha = alphas[k]
        if alpha == 0:
            yield k, s.copy(), np.linalg.pinv(s, hermitian=True) if p > 1 else 1 / np.maximum(s, 1e-12)
            continue
        t = min(1.0, alpha / above)
        start, before, w, theta = t * w + (1 - t) * s, theta, diag.copy(), np.zeros_like(s)
        for c in found.at(alpha):
            if len(c) == 1:
                theta[c, c] = 1 / np.maximum(s[c, c], 1e-12)
                continue
            at = np.ix_(c, c)
            w[at], theta[at] = newton(s[at], alpha, start[at], max_iter, tol) or block(s[at], alpha, start[at], betas_of(before[at]), max_iter, tol, enet_tol)
        above = min(above, alpha)
        yield k, w, theta
