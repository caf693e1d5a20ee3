"""A small causal self-attention language model in numpy, over subword numbers.

One block: token and position embeddings, one masked attention head and a feed-forward layer, both residual. The next
number is predicted in two steps, its class and its place in the class, each a softmax of the block's output plus the
logarithm of a bigram estimate from corpus counts. The block starts as the bigram model and learns what the wider
context adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Numbers, classes, width, feed-forward width, window and the part of it that is scored (the rest is context).
NUMBERS, CLASSES, WIDTH, INNER, WINDOW, SCORED = 2048, 32, 16, 32, 64, 48
MEMBERS = NUMBERS // CLASSES
#: Rows of one class that are scored together: their logits stay in the processor's cache.
CHUNK = 1024
#: Windows that go through the block together: their weights stay there too.
GROUP = 32


def bigram_tables(pairs: np.ndarray, counts: np.ndarray, pull: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """log P(class | previous) and, class first, log P(member | class, previous) from counts, pulled towards the single
    counts."""
    single = (counts + 0.5) / (counts.sum() + 0.5 * NUMBERS)
    p = (pairs + pull * single[None, :]) / (pairs.sum(axis=1, keepdims=True) + pull)
    p = p.reshape(NUMBERS, CLASSES, MEMBERS)
    of_class = p.sum(axis=2)
    members = np.log(p / of_class[:, :, None]).astype(np.float32)
    return np.log(of_class).astype(np.float32), np.ascontiguousarray(members.transpose(1, 0, 2))


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in the concatenated texts), length and first scored place of every window over texts of these lengths.

    A text's first window scores all its places; each further one starts SCORED later and scores those not yet scored.
    """
    each = np.maximum(1, 1 + -(-(lengths - WINDOW) // SCORED))
    each[lengths == 0] = 0
    text = np.repeat(np.arange(len(lengths)), each)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    start = nth * SCORED
    size = np.minimum(WINDOW, lengths[text] - start)
    return (np.cumsum(lengths) - lengths)[text] + start, size, np.where(nth == 0, 0, WINDOW - SCORED)


class Attention:
    def __init__(self, class_table: np.ndarray, member_table: np.ndarray, seed: int = 2):
        draw = np.random.default_rng(seed)
        dense = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.class_table, self.member_table = class_table, member_table
        self.w = {
            "e": (0.5 * draw.standard_normal((NUMBERS, WIDTH))).astype(np.float32), "p": (0.1 * draw.standard_normal((WINDOW, WIDTH))).astype(np.float32),
            "q": dense(WIDTH, WIDTH), "k": dense(WIDTH, WIDTH), "v": dense(WIDTH, WIDTH), "o": dense(WIDTH, WIDTH), "1": dense(WIDTH, INNER), "b": np.zeros(INNER, np.float32), "2": dense(INNER, WIDTH),
            "c": np.zeros((WIDTH, CLASSES), np.float32), "m": np.zeros((CLASSES, WIDTH, MEMBERS), np.float32),
        }
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What a number and what a place bring to h, q (scaled), k, v and a column of ones, which sums the weights."""
        w = self.w
        project = np.concatenate([np.eye(WIDTH, dtype=w["e"].dtype), w["q"] * np.float32(WIDTH**-0.5), w["k"], w["v"]], axis=1)
        last = lambda a, x: np.concatenate([a @ project, np.full((len(a), 1), x, a.dtype)], axis=1)
        return last(w["e"], 1), last(w["p"], 0)

    def _block(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray], first: int = 0) -> dict[str, np.ndarray]:
        """x: windows of numbers, (n, length); outputs of the places from `first` on. Later places are masked, so padding
        at the end changes nothing before it."""
        w, length = self.w, x.shape[1]
        t = np.take(tables[0], x, axis=0)
        t += tables[1][:length]
        h, q, k, v = t[:, first:, :WIDTH], t[:, first:, WIDTH : 2 * WIDTH], t[:, :, 2 * WIDTH : 3 * WIDTH], t[:, :, 3 * WIDTH :]
        s = q @ k.transpose(0, 2, 1)
        _bounded(s)
        np.exp(s, out=s)
        s *= self.mask[first:length, :length]
        u = s @ v
        total = u[:, :, WIDTH:]
        u = u[:, :, :WIDTH] / total
        o = u.reshape(-1, WIDTH) @ w["o"]  # one product of matrices, not one a window
        o += h.reshape(-1, WIDTH)
        r = o @ w["1"]
        r += w["b"]
        np.maximum(r, 0, out=r)
        z = r @ w["2"]
        z += o
        return {"h": h, "q": q, "k": k, "v": v, "s": s, "total": total, "u": u, "o": o, "r": r, "z": z}

    def _heads(self, z: np.ndarray, prev: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability of each target; with grads, also the gradient of the mean loss with respect to z."""
        w, n = self.w, len(z)
        kind, place = target // MEMBERS, target % MEMBERS
        dz = None
        if grads is not None:
            grads["c"], grads["m"], dz = np.zeros((CLASSES, WIDTH), z.dtype), np.zeros((CLASSES, MEMBERS, WIDTH), z.dtype), np.empty_like(z)

        def softmax(z: np.ndarray, rows: slice, picked: np.ndarray, tables: np.ndarray, at: np.ndarray, parts: list, weights: np.ndarray, grad: np.ndarray | None, back: np.ndarray | None) -> np.ndarray:
            """Log-probabilities of CHUNK rows at most; parts: (a row of the weights, from, to), a product each."""
            # the tables are logarithms of shares, so that the sums below are about one before anything is learnt
            logits = np.empty((len(picked), tables.shape[1]), z.dtype)
            for c, start, end in parts:
                np.matmul(z[start:end], weights[c], out=logits[start - rows.start : end - rows.start])
            logits += np.take(tables, at, axis=0)
            _bounded(logits)
            flat = logits.reshape(-1)
            chosen = np.arange(len(logits)) * logits.shape[1] + picked
            scores = flat[chosen]
            np.exp(logits, out=logits)
            total = logits @ np.ones(logits.shape[1], logits.dtype)
            scores -= np.log(total)
            if grad is not None:
                logits *= (1 / total)[:, None]
                flat[chosen] -= 1
                for c, start, end in parts:
                    part = logits[start - rows.start : end - rows.start]
                    grad[c] += part.T @ z[start:end]
                    np.matmul(part, weights[c].T, out=back[start:end])
            return scores

        out = np.empty(n, z.dtype)
        for start in range(0, n, CHUNK):
            rows = slice(start, min(n, start + CHUNK))
            out[rows] = softmax(z, rows, kind[rows], self.class_table, prev[rows], [(0, start, rows.stop)], w["c"][None], grads and grads["c"][None], dz)
        # sorted by class once, then a contiguous product for each class
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(kind, minlength=CLASSES))
        zs, place, at = np.take(z, order, axis=0), place[order], (kind * NUMBERS + prev)[order]
        scores, back = np.empty(n, z.dtype), None if grads is None else np.empty_like(zs)
        tables = self.member_table.reshape(-1, MEMBERS)
        for start in range(0, n, CHUNK):
            rows = slice(start, min(n, start + CHUNK))
            cuts = [start, *ends[(ends > start) & (ends < rows.stop)].tolist(), rows.stop]
            classes = np.searchsorted(ends, cuts[:-1], "right").tolist()
            scores[rows] = softmax(zs, rows, place[rows], tables, at[rows], list(zip(classes, cuts[:-1], cuts[1:], strict=True)), w["m"], grads and grads["m"], back)
        there = np.empty_like(order)
        there[order] = np.arange(n)
        out += scores[there]
        if grads is not None:
            dz += np.take(back, there, axis=0)
            dz /= n
            grads["c"], grads["m"] = grads["c"].T / n, grads["m"].transpose(0, 2, 1) / n
        return out, dz

    def _step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over whole windows and its gradients."""
        w, tables, length = self.w, self._tables(), x.shape[1]
        g: dict[str, np.ndarray] = {k: np.zeros_like(v) for k, v in w.items() if k not in "cm"}
        groups = [slice(start, start + GROUP) for start in range(0, len(x), GROUP)]
        told = [self._block(x[rows], tables) for rows in groups]
        scored, dzs = self._heads(np.concatenate([f["z"] for f in told]), x.ravel(), y.ravel(), g)
        project = np.concatenate([w["q"] * np.float32(WIDTH**-0.5), w["k"], w["v"]], axis=1)
        projected, dhs = np.zeros_like(project), np.empty_like(dzs)
        for rows, f in zip(groups, told, strict=True):
            flat = slice(rows.start * length, rows.stop * length)
            dz, u = dzs[flat], f["u"]
            g["2"] += f["r"].T @ dz
            da = dz @ w["2"].T
            da *= f["r"] > 0
            g["1"] += f["o"].T @ da
            g["b"] += np.ones(len(da), da.dtype) @ da
            do = dz + da @ w["1"].T
            g["o"] += u.reshape(-1, WIDTH).T @ do
            du = (do @ w["o"].T).reshape(u.shape)
            du /= f["total"]
            d = np.empty((*u.shape[:2], 3 * WIDTH), do.dtype)
            s = f["s"]  # weights before they are divided by their total
            d[:, :, 2 * WIDTH :] = s.transpose(0, 2, 1) @ du
            ds = du @ f["v"][:, :, :WIDTH].transpose(0, 2, 1)
            ds -= np.einsum("nld,nld->nl", du, u)[:, :, None]
            ds *= s
            d[:, :, :WIDTH] = ds @ f["k"]
            d[:, :, WIDTH : 2 * WIDTH] = ds.transpose(0, 2, 1) @ f["q"]
            d = d.reshape(-1, 3 * WIDTH)
            projected += f["h"].reshape(-1, WIDTH).T @ d
            do += d @ project.T
            dhs[flat] = do
        # q in `f` holds the scale already, which dk needs and q's own weights do not
        g["q"], g["k"], g["v"] = np.split(projected, 3, axis=1)
        g["q"] = g["q"] * np.float32(WIDTH**-0.5)
        g["e"] = np.stack([np.bincount(x.ravel(), column, NUMBERS) for column in dhs.T], axis=1).astype(dhs.dtype)
        g["p"][:length] = dhs.reshape(-1, length, WIDTH).sum(axis=0)
        return float(-scored.mean()), g

    def score(self, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray, together: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, natural log-probabilities) of all targets, each once; texts are concatenated, `lengths` parts them."""
        start, size, skip = windows(lengths)
        order, tables = np.lexsort((size, skip)), self._tables()
        for at in range(0, len(order), together):
            here, z = [], []
            for first in range(at, min(at + together, len(order)), GROUP):
                rows = order[first : min(first + GROUP, at + together)]
                skipped, length = int(skip[rows[0]]), int(size[rows].max())  # the least that is skipped: they are in order
                place = start[rows, None] + np.arange(length)
                real = np.arange(length) < size[rows, None]
                real &= np.arange(length) >= skip[rows, None]
                real = real[:, skipped:]
                place = np.minimum(place, len(inputs) - 1)
                out = self._block(inputs[place], tables, skipped)["z"]
                whole = real.all()
                z.append(out if whole else out[real.ravel()])
                place = place[:, skipped:]
                here.append(place.ravel() if whole else place[real])
            here = np.concatenate(here)
            yield here, self._heads(np.concatenate(z), inputs[here].astype(np.int64), targets[here].astype(np.int64))[0]


def _bounded(logits: np.ndarray) -> None:
    """Far beyond what is learnt; the exponential stays finite."""
    if logits.size and not logits.max() <= 60:
        np.minimum(logits, 60, out=logits)


class Trainer:
    """Adam over a stream of numbers of any length; every place is trained on.

    Windows are filled across calls; finish() trains on what does not fill one. What comes in before LEAST steps are
    done is gone through up to eight times, all else once.
    """

    LEAST, BATCH = 200, 128

    def __init__(self, model: Attention, rate: float = 4e-3, seed: int = 2):
        self.model, self.rate, self.draw, self.steps, self.places = model, rate, np.random.default_rng(seed), 0, 0
        # all weights are one array, of which the model's are views
        self.flat, at = np.concatenate([v.ravel() for v in model.w.values()]), 0
        for k, v in model.w.items():
            model.w[k] = self.flat[at : at + v.size].reshape(v.shape)
            at += v.size
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.rest = np.zeros((2, 0), np.uint16)

    def add(self, inputs: np.ndarray, targets: np.ndarray) -> list[float]:
        """The losses of the steps taken."""
        told = np.concatenate([self.rest, np.stack([inputs, targets]).astype(np.uint16)], axis=1)
        whole = told.shape[1] // WINDOW * WINDOW
        self.rest = told[:, whole:]
        return self._pass(*(row.reshape(-1, WINDOW) for row in told[:, :whole]))

    def finish(self) -> None:
        if self.rest.size:
            self._pass(*(row[None, :] for row in self.rest))
            self.rest = self.rest[:, :0]

    def _pass(self, x: np.ndarray, y: np.ndarray) -> list[float]:
        losses: list[float] = []
        if not len(x):
            return losses
        self.places += x.size
        each = -(-len(x) // self.BATCH)
        for _ in range(min(8, max(1, -(-(self.LEAST - self.steps) // each)))):
            for rows in np.array_split(self.draw.permutation(len(x)), each):
                losses.append(self._step(x[rows].astype(np.int64), y[rows].astype(np.int64)))
        return losses

    def _step(self, x: np.ndarray, y: np.ndarray) -> float:
        loss, g = self.model._step(x, y)
        self.steps += 1
        d, step = np.concatenate([g[k].ravel() for k in self.model.w]), self.steps
        d *= np.float32(min(1.0, 1.0 / (1e-12 + np.sqrt(float(d @ d)))))
        now = self.rate * min(1.0, step / 20) / np.sqrt(1 + step / self.LEAST)
        self.first *= np.float32(0.9)
        self.first += np.float32(0.1) * d
        d *= d
        self.second *= np.float32(0.98)
        self.second += np.float32(0.02) * d
        np.multiply(self.second, np.float32(1 / (1 - 0.98**step)), out=d)
        np.sqrt(d, out=d)
        d += np.float32(1e-8)
        np.divide(self.first, d, out=d)
        d *= np.float32(now / (1 - 0.9**step))
        self.flat -= d
        return loss
