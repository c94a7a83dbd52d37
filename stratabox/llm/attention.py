"""A one-layer causal self-attention model in numpy: forward, backward, and scoring in overlapping windows."""

from __future__ import annotations

import numpy as np

BLOCKED = np.float32(-1e9)
CELLS = 1 << 16  # odds that are taken at a time: they stay in a core's cache
SAFE = 60.0  # odds up to this size need no largest one taken off before their exponentials are added up


def longest(rows: np.ndarray) -> float:
    """The largest length of a vector in the last dimension."""
    return float(np.sqrt(np.einsum("...i,...i->...", rows, rows).max(initial=0)))


class Attention:
    """Predicts a class from the slots so far, and within a class with `members` which of these slots it is. tables: `slots` x `width`
    embeddings; a fixed table of log odds by last slot is added to what attention gives for classes, a learned bias for members."""

    def __init__(self, slots: int, classes: int, window: int, overlap: int, prior: np.ndarray, width: int = 16, seed: int = 3, members: dict[int, np.ndarray] | None = None, weight: np.ndarray | None = None):
        """members: of a class its slots; weight: how often each slot is met."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.window, self.overlap, self.width, self.prior = window, overlap, width, prior.astype(np.float32)
        self.p = {
            "e": draw(slots, width, by=0.3), "q": draw(width, width, by=0.25), "k": draw(width, width, by=0.25), "v": draw(width, width, by=0.25),
            "o": draw(width, classes, by=0.05), "b": np.zeros(classes, np.float32), "r": np.zeros(window, np.float32),
        }
        self.members = members or {}
        if self.members:
            self.p["m"], self.p["mb"] = draw(slots, width, by=0.05), np.log(weight + 0.1).astype(np.float32)
            self.place = np.zeros(slots, np.int64)  # of a slot among its class's members
            for own in self.members.values():
                self.place[own] = np.arange(len(own))
            cuts = np.cumsum([0, *map(len, self.members.values())]).tolist()
            self.all_members, self.span = np.concatenate([*self.members.values()]), dict(zip(self.members, map(slice, cuts, cuts[1:]), strict=False))
        self.ahead = np.triu(np.ones((window, window), bool), 1)
        self.gap = np.clip(np.arange(window)[:, None] - np.arange(window)[None, :], 0, window - 1)

    def bias(self) -> np.ndarray:
        return np.where(self.ahead, BLOCKED, self.p["r"][self.gap]).astype(np.float32)

    def fit(self, batches, rate: float = 0.02) -> None:
        """batches: (slots, classes, members) of windows; a class of -1 is not scored, a member of -1 not looked for. Adam, a step for each."""
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step, (s, y, z) in enumerate(batches, 1):
            for k, g in self.slopes(s, y, z).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.__dict__.pop("held", None)

    def flat(self) -> np.ndarray:
        """All parameters in a row."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def moved(self, by: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = (self.p[k] + by[at : at + n].reshape(self.p[k].shape)).astype(np.float32)
            at += n
        self.__dict__.pop("held", None)

    def slopes(self, s: np.ndarray, y: np.ndarray, z: np.ndarray | None = None) -> dict[str, np.ndarray]:
        s, y, z = (None if x is None else x[self.late_first(y)] for x in (s, y, z))
        p, d, scale, many = self.p, self.width, 1 / np.sqrt(self.width, dtype=np.float32), self.many()
        x, bias, kind, cuts = p["e"][s], self.bias(), p["e"].dtype, self.chunks(y)
        tables = np.concatenate([p["q"] * scale, p["k"], p["v"]], 1)
        by_slot = np.concatenate([p["e"] @ tables, np.ones((len(p["e"]), 1), kind)], 1)  # queries, keys, values, and ones, which add up a place's chances
        made, steep = np.empty((*s.shape, 3 * d + 1), kind), longest(by_slot[:, :d]) * longest(by_slot[:, d : 2 * d]) + np.abs(p["r"]).max() > SAFE
        a, h, total = np.empty((*s.shape, s.shape[1]), kind), np.zeros((*s.shape, d + 1), kind), np.ones((*s.shape, 1), kind)
        for at, skip in cuts:
            np.take(by_slot, s[at], 0, out=made[at], mode="clip")
            q, k = made[at, skip:, :d], made[at, :, d : 2 * d]
            odds = np.matmul(q, k.transpose(0, 2, 1), out=a[at, skip:])
            odds += bias[skip:]
            if steep:
                odds -= odds.max(2, keepdims=True)
            np.exp(odds, out=odds)
            mixed = np.matmul(odds, made[at, :, 2 * d :], out=h[at, skip:])
            total[at, skip:] = mixed[:, :, d:]
            mixed /= total[at, skip:]
        # only what is scored here has odds
        rows = np.flatnonzero(y.ravel() >= 0)
        target, slots, share = y.ravel()[rows], s.ravel()[rows], np.float32(1 / max(1, len(rows)))
        met = h.reshape(-1, d + 1)[rows]
        met[:, :d] += x.reshape(-1, d)[rows]  # the last column is 1
        met_g, wide = np.empty((len(rows), d), kind), longest(met)
        table, o_g = np.concatenate([p["o"], p["b"][None]]), np.zeros((d + 1, len(p["b"])), kind)
        back = np.concatenate([p["o"], np.ones((1, len(p["b"])), kind)]).T.copy()
        steep = wide * longest(table.T) + max(0, self.prior.max()) > SAFE
        for low in range(0, len(rows), many):
            own, wanted = met[low : low + many], target[low : low + many]
            prob = own @ table
            prob += self.prior[slots[low : low + many]]
            met_g[low : low + many], of = self.chosen(prob, wanted, back, steep)
            o_g += (own * of).T @ prob
        out = {"o": o_g[:-1] * share, "b": o_g[-1] * share}
        if self.members:
            table = np.concatenate([p["m"], p["mb"][:, None]], 1)
            table, steep = table[self.all_members], wide * longest(p["m"]) + np.abs(p["mb"]).max() > SAFE
            m_g, wanted, back = np.zeros_like(table), z.ravel()[rows], np.concatenate([table[:, :-1], np.ones((len(table), 1), kind)], 1)
            order, groups = self.within(target, wanted)
            own, wanted, by = met[order], self.place[wanted[order]], np.empty((len(order), d), kind)
            for at, members in groups:
                prob = own[at] @ table[members].T
                by[at], of = self.chosen(prob, wanted[at], back[members], steep)
                m_g[members] = prob.T @ (own[at] * of)
            met_g[order] += by
            m_g *= share
            out["m"], out["mb"] = np.zeros_like(p["m"]), np.zeros_like(p["mb"])
            out["m"][self.all_members], out["mb"][self.all_members] = m_g[:, :-1], m_g[:, -1]
        gx = np.zeros((s.size, d), kind)
        gx[rows] = met_g * share
        gx = gx.reshape(x.shape)
        near, sums, turned = np.zeros_like(bias), np.zeros_like(tables), np.ascontiguousarray(tables.T)
        for at, skip in cuts:
            odds, got, mixed = a[at, skip:], gx[at, skip:], h[at, skip:, :d]
            # slopes of a place's odds: its chances times what each value gives beyond the mean of all
            left = np.concatenate([got, -np.einsum("ijk,ijk->ij", got, mixed)[:, :, None]], 2)
            left /= total[at, skip:]
            gs = left @ made[at, :, 2 * d :].transpose(0, 2, 1)
            gs *= odds
            near[skip:] += (np.ones(len(gs), kind) @ gs.reshape(len(gs), -1)).reshape(gs.shape[1:])
            g = np.zeros((*x[at].shape[:2], 3 * d), kind)
            np.matmul(gs, made[at, :, d : 2 * d], out=g[:, skip:, :d])
            np.matmul(gs.transpose(0, 2, 1), made[at, skip:, :d], out=g[:, :, d : 2 * d])
            np.matmul(odds.transpose(0, 2, 1), left[:, :, :d], out=g[:, :, 2 * d :])
            g = g.reshape(-1, 3 * d)
            sums += x[at].reshape(-1, d).T @ g
            gx[at] += (g @ turned).reshape(x[at].shape)
        out["r"] = np.bincount(self.gap[~self.ahead], near[~self.ahead], self.window).astype(np.float32)
        out["q"], out["k"], out["v"] = sums[:, :d] * scale, sums[:, d : 2 * d], sums[:, 2 * d :]
        ids, columns = s.ravel(), gx.reshape(-1, d).T
        out["e"] = np.stack([np.bincount(ids, c, len(p["e"])) for c in columns], 1).astype(np.float32)
        return out

    def late_first(self, y: np.ndarray) -> np.ndarray:
        """An order of windows that puts those first whose first `overlap` places are not scored."""
        return np.argsort((y[:, : self.overlap] >= 0).any(1), kind="stable")

    def chunks(self, y: np.ndarray) -> list[tuple[slice, int]]:
        """Windows that are worked on at a time, and how many of their first places none of them scores: these need no odds."""
        cuts = [slice(low, low + self.few()) for low in range(0, len(y), self.few())]
        return [(at, 0 if (y[at, : self.overlap] >= 0).any() else self.overlap) for at in cuts]

    def few(self) -> int:
        return max(1, CELLS // self.window**2)

    def many(self) -> int:
        return max(1, CELLS // self.prior.shape[1])

    @staticmethod
    def chosen(odds: np.ndarray, target: np.ndarray, back: np.ndarray, steep: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of odds, and which is met: the slopes by the rows' states (back: the odds' table and a column of ones), and a factor for
        each row, by which `odds`, changed in place, are the slopes by the odds."""
        if steep:
            odds -= odds.max(1, keepdims=True)
        np.exp(odds, out=odds)
        by = odds @ back
        of = 1 / by[:, -1:]
        odds[np.arange(len(odds)), target] -= by[:, -1]
        by *= of
        by -= back[target]
        return by[:, :-1], of

    def within(self, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """The places where a member is looked for, by class; and of each class that is met its places among these, and its members among
        all_members."""
        wanted = np.flatnonzero((z >= 0) & (y >= 0))
        order = wanted[np.argsort(y[wanted], kind="stable")]
        cuts = np.flatnonzero(np.diff(y[order], prepend=-2))
        # without any cut there is nothing
        return order, [(slice(low, high), self.span[int(y[order[low]])]) for low, high in zip(cuts, np.append(cuts[1:], len(order)), strict=False)]

    def prepare(self) -> tuple:
        """What scoring looks up: queries, keys, values and ones by slot; of each slot its own odds of classes, the largest 0, and their
        exponentials; members and their biases; and whether the odds of places, classes and members can grow too large for exponentials."""
        p, d = self.p, self.width
        scale = np.float32(1 / np.sqrt(self.width))
        tables = np.concatenate([p["e"] @ p["q"] * scale, p["e"] @ p["k"], p["e"] @ p["v"], np.ones((len(p["e"]), 1), p["e"].dtype)], 1)
        direct = p["e"] @ p["o"] + p["b"] + self.prior
        direct -= direct.max(1, keepdims=True)
        value = longest(tables[:, 2 * d : 3 * d])
        steep = [longest(tables[:, :d]) * longest(tables[:, d : 2 * d]) + np.abs(p["r"]).max() > SAFE, value * longest(p["o"].T) > SAFE, False]
        members = None
        if self.members:
            members = np.concatenate([p["m"], p["mb"][:, None]], 1)[self.all_members]
            steep[2] = (value + longest(p["e"])) * longest(p["m"]) + np.abs(p["mb"]).max() > SAFE
        return np.ascontiguousarray(tables), np.ascontiguousarray(direct), np.exp(direct), members, self.bias(), steep

    def log_probs(self, s: np.ndarray, y: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the probability of each target (0 where its class is -1), windows in batches."""
        if "held" not in self.__dict__:
            self.held = self.prepare()
        tables, direct, weights, members, bias, steep = self.held
        d, many, out = self.width, self.many(), np.zeros(y.shape, np.float32)
        order = self.late_first(y)
        for at in range(0, len(s), 2048):
            chosen = order[at : at + 2048]
            own, classes = s[chosen], y[chosen]
            mixed = np.empty((*own.shape, d + 1), tables.dtype)
            for few, skip in self.chunks(classes):
                x = tables[own[few]]
                score = x[:, skip:, :d] @ x[:, :, d : 2 * d].transpose(0, 2, 1)
                score += bias[skip:]
                if steep[0]:
                    score -= score.max(2, keepdims=True)
                np.exp(score, out=score)
                np.matmul(score, x[:, :, 2 * d :], out=mixed[few, skip:])
            # what another window scores needs no odds here
            rows = np.flatnonzero(classes >= 0)
            mixed, slots, target = mixed.reshape(-1, d + 1)[rows], own.ravel()[rows], classes.ravel()[rows]
            mixed /= mixed[:, d:]  # the last column is 1 now
            lp = np.empty(len(rows), np.float32)
            for low in range(0, len(rows), many):
                by, wanted = slots[low : low + many], target[low : low + many]
                logits = mixed[low : low + many, :d] @ self.p["o"]
                if steep[1]:
                    logits += direct[by]
                    logits -= logits.max(1, keepdims=True)
                    lp[low : low + many] = logits[np.arange(len(by)), wanted] - np.log(np.exp(logits).sum(1))
                    continue
                picked = logits[np.arange(len(by)), wanted] + direct[by, wanted]
                np.exp(logits, out=logits)
                lp[low : low + many] = picked - np.log(np.einsum("ij,ij->i", logits, weights[by]))
            if self.members:
                wanted = z[chosen].ravel()[rows]
                mixed[:, :d] += self.p["e"][slots]
                met, groups = self.within(target, wanted)
                mixed, wanted, found = mixed[met], self.place[wanted[met]], np.empty(len(met), np.float32)
                for few, own in groups:
                    odds = mixed[few] @ members[own].T
                    if steep[2]:
                        odds -= odds.max(1, keepdims=True)
                    picked = odds[np.arange(len(odds)), wanted[few]]
                    np.exp(odds, out=odds)
                    found[few] = picked - np.log(odds.sum(1))
                lp[met] += found
            out[chosen[rows // y.shape[1]], rows % y.shape[1]] = lp
        return out

    def windows(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sequences laid end to end: positions (windows, window), whether a position is scored there, and the sequence of each
        window. Each window but a sequence's first begins with `overlap` positions that the one before has scored."""
        step = self.window - self.overlap
        count = np.maximum(1, -(-(lengths - self.overlap) // step))
        count[lengths == 0] = 0
        owner = np.repeat(np.arange(len(lengths)), count)
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        number = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count)
        inside = (number * step)[:, None] + np.arange(self.window)
        real = inside < lengths[owner][:, None]
        scored = real & ((number == 0)[:, None] | (np.arange(self.window) >= self.overlap))
        return starts[owner][:, None] + np.where(real, inside, 0), scored, owner

    def sums(self, slots: np.ndarray, targets: np.ndarray, lengths: np.ndarray, members: np.ndarray | None = None) -> np.ndarray:
        """The log probability of each sequence."""
        at, scored, owner = self.windows(lengths)
        out = np.zeros(len(lengths))
        for low in range(0, len(at), 8192):
            a, k = at[low : low + 8192], scored[low : low + 8192]
            lp = self.log_probs(slots[a], np.where(k, targets[a], -1), None if members is None else np.where(k, members[a], -1))
            out += np.bincount(owner[low : low + 8192], lp.sum(1, dtype=np.float64), len(lengths))
        return out
