"""A small causal self-attention model over subword ids, in NumPy.

A token sees itself and the ``BACK`` tokens before it.  Texts are cut into blocks
of ``BLOCK`` tokens; a window is a block and the ``BACK`` tokens before it, so windows
overlap and each token is scored once, by a batched product of queries and keys
under a mask.  Positions enter as a bias for each distance, so queries, keys and
values depend on the token alone.

The probability of a subword is that of its class times its share of the class.
Frequent subwords are classes of their own; the others of a class are leaves of a binary
tree over its subwords in order of their counts, each range cut where half of its mass
ends, and a share is the product of the choices on the way.  Choices of classes and in
trees start from counts after each of ``AFTER`` groups of subwords (the frequent ones
alone), joined to those without context: untaught, a share is (n(group, id) + PRIOR *
share) / (n(group, class) + PRIOR), and a class's is formed alike.  Attention learns what
the tokens before the last one, and the last one itself, change about every choice, so
it tells all subwords of the tokenizer apart.

The ``TOP`` nodes of a tree with most mass, through which most ways go, are computed
for all tokens of the tree together, as a product of matrices in which a sign of 0 takes
out the nodes that aren't on a token's way; the nodes below are gathered choice by choice.
Which nodes are at the top changes the order of sums, and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np

BLOCK, BACK = 16, 8
REACH = BACK + 1
DIM, CLASSES, INPUTS, AFTER, PRIOR = 8, 32, 2048, 1024, 4.0
SINGLE = (CLASSES * 3) // 4  # so many frequent subwords are classes of their own
TOP = 32  # nodes of a tree that are computed for all its tokens
SOME = 8  # batches whose choices are looked up together
_F = np.float32


@dataclass
class Trees:
    """Binary trees of the classes: node k parts the ranks [low, high) at ``cut``; the way to an id is of nodes of ``top``, where ``turn`` isn't 0, and ``size`` nodes from ``first``."""

    ids: np.ndarray  # of each rank
    low: np.ndarray
    cut: np.ndarray
    high: np.ndarray
    first: np.ndarray
    size: np.ndarray
    nodes: np.ndarray
    left: np.ndarray  # 1 where the way goes left, else -1
    tree: np.ndarray  # of each id, or the number of trees; at last of no id
    top: np.ndarray  # (trees, TOP) nodes with most mass; -1: none
    turn: np.ndarray  # (ids, TOP) -1 where the way goes left at that node, 1 where it goes right, else 0

    @classmethod
    def of(cls, ids: np.ndarray, bounds: np.ndarray, mass: np.ndarray) -> Trees:
        """Ids in order of ranks, with their masses; each range of ranks between bounds is a tree."""
        upto = np.append(0, np.cumsum(mass))
        low, high = bounds[:-1], bounds[1:]
        made, ways, n = [], [], 0
        while True:
            some = high - low > 1
            low, high = low[some], high[some]
            if not len(low):
                break
            cut = np.clip(np.searchsorted(upto, (upto[low] + upto[high]) / 2), low + 1, high - 1)
            made.append((low, cut, high))
            size = high - low
            at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
            ways.append((at, np.repeat(np.arange(n, n + len(low)), size), np.where(at < np.repeat(cut, size), 1, -1)))
            n += len(low)
            low, high = np.stack([low, cut], 1).ravel(), np.stack([cut, high], 1).ravel()
        low, cut, high = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (zip(*made) if made else ((), (), ())))
        at, nodes, left = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (zip(*ways) if ways else ((), (), ())))
        # nodes by the first rank below them, so that those with counts stand first
        order = np.argsort(low, kind="stable")
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        low, cut, high, nodes = low[order], cut[order], high[order], number[nodes]
        of = np.searchsorted(bounds, low, "right") - 1
        heavy = np.lexsort((low, cut, upto[low] - upto[high], of))
        place = np.empty(n, np.int64)  # by mass in the tree
        place[heavy] = np.arange(n) - np.searchsorted(of[heavy], of[heavy])
        top = np.full((len(bounds) - 1, TOP), -1, np.intp)
        above = np.flatnonzero(place < TOP)
        top[of[above], place[above]] = above
        turn, above = np.zeros((len(ids), TOP), np.int8), place[nodes] < TOP
        turn[ids[at[above]], place[nodes[above]]] = -left[above]
        tree = np.full(len(ids) + 1, len(top), np.uint8)
        tree[ids[at]] = of[nodes]
        at, nodes, left = at[~above], nodes[~above], left[~above]
        by_rank = np.argsort(at, kind="stable")
        size = np.bincount(at, minlength=len(ids))
        rank = np.empty(len(ids), np.int64)
        rank[ids] = np.arange(len(ids))
        first = (np.cumsum(size) - size)[rank]
        return cls(ids, low, cut, high, first.astype(np.intp), np.append(size[rank], 0),
                   nodes[by_rank].astype(np.intp), left[by_rank].astype(_F), tree, top, turn)


@dataclass
class Vocabulary:
    """Classes of subword ids, from counts; id n is the end of a text, id n + 1 what stands before it."""

    inputs: np.ndarray
    outputs: np.ndarray
    share: np.ndarray  # times PRIOR
    log_class: np.ndarray
    groups: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((AFTER, INPUTS), _F))
    pairs_class: np.ndarray = field(default_factory=lambda: np.zeros((AFTER, CLASSES), _F))
    start: np.ndarray | None = None
    trees: Trees | None = None

    @classmethod
    def of(cls, counts: np.ndarray, classes: int = CLASSES, inputs: int = INPUTS, after: int = AFTER) -> Vocabulary:
        """counts: of each subword id, and at last of ends."""
        n = len(counts)
        assert after * inputs < 1 << 31
        order = np.lexsort((np.arange(n), -counts))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        end, single = n - 1, SINGLE
        outputs = np.where(rank < single, rank, -1)
        rest = order[single:]
        mass = np.cumsum(counts[rest] + 0.1)
        bins = classes - single
        outputs[rest] = single + np.minimum((mass / mass[-1] * bins).astype(np.int64), bins - 1) if len(rest) else 0
        seen = counts + 0.1
        of_class = np.bincount(outputs, seen, classes)
        log_class = np.log(np.maximum(of_class, 1e-9) / seen.sum())
        keep = inputs - 64
        table = np.where(rank < keep, rank, keep + rank % 62)
        table = np.append(table, inputs - 1)  # what stands before a text
        table[end] = inputs - 2
        alone = after - 128
        groups = np.append(np.where(rank < alone, rank, alone + rank % 127), after - 1)
        bounds = np.append(np.flatnonzero(np.diff(outputs[rest], prepend=-1)), len(rest)) + min(single, n)
        return cls(table.astype(np.intp), outputs.astype(np.intp), (PRIOR * seen / of_class[outputs]).astype(_F), log_class, groups.astype(np.intp),
                   trees=Trees.of(order, bounds, seen[order]))

    def place(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Where the count of a token after another stands; -1 for tokens that share an input or are a class."""
        at = self.inputs[token]
        counted = (at < INPUTS - 64) & (self.outputs[token] >= SINGLE)
        return np.where(counted, self.groups[before].astype(np.int32) * np.int32(INPUTS) + at.astype(np.int32), np.int32(-1))

    def with_pairs(self, counts: np.ndarray, classes: np.ndarray) -> Vocabulary:
        """The vocabulary with counts (AFTER, INPUTS) of tokens and (AFTER, CLASSES) of classes after groups."""
        known = np.flatnonzero(self.inputs[:-1] < INPUTS - 64)
        of_input = np.zeros((INPUTS, CLASSES))
        of_input[self.inputs[known], self.outputs[known]] = 1
        prior = 16 * PRIOR * np.exp(self.log_class)
        start = np.log((classes + prior) / (classes.sum(axis=1, keepdims=True) + prior.sum()))
        return Vocabulary(self.inputs, self.outputs, self.share, self.log_class, self.groups,
                          counts.astype(_F), (counts @ of_input).astype(_F), start.astype(_F), self.trees)

    def starts(self, shift: np.ndarray) -> np.ndarray:
        """(AFTER, CLASSES): where the logits start after each group, and a shift of each class."""
        return (np.broadcast_to(self.log_class.astype(_F), (AFTER, CLASSES)) if self.start is None else self.start) + shift

    @cached_property
    def odds(self) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of going left that counts give: (AFTER, nodes above counted ids) after each group, and of every node without context."""
        t, keep = self.trees, INPUTS - 64
        share = np.append(0, np.cumsum(self.share[t.ids].astype(float)))
        prior = share[t.cut] - share[t.low], share[t.high] - share[t.cut]
        n = int(np.searchsorted(t.low, keep))
        upto = np.zeros((AFTER, keep + 1))
        np.cumsum(self.pairs[:, :keep], axis=1, out=upto[:, 1:])
        low, cut, high = (upto[:, np.minimum(x[:n], keep)] for x in (t.low, t.cut, t.high))
        after = np.log((cut - low + prior[0][:n]) / (high - cut + prior[1][:n]))
        return np.ascontiguousarray(after, _F), np.log(prior[0] / prior[1]).astype(_F)

    def of_tokens(self, tokens: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
        """The vocabulary with no nodes but those on the ways to these tokens, and their numbers."""
        t, (after, always) = self.trees, self.odds
        seen = np.flatnonzero(np.bincount(tokens, minlength=len(self.outputs)))
        size = t.size[seen]
        at = np.repeat(t.first[seen] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        of = t.tree[seen]
        on = np.stack([(t.turn[seen[of == k]] != 0).any(axis=0) for k in range(len(t.top))]) if len(t.top) else t.top > 0
        used = np.unique(np.concatenate([t.nodes[at], t.top[on]]))
        number = np.zeros(len(t.low), np.intp)
        number[used] = np.arange(len(used))
        out = replace(self, trees=replace(t, nodes=number[t.nodes], top=np.where(on, number[t.top] if len(number) else t.top, -1)))
        out.odds = np.ascontiguousarray(after[:, used[used < after.shape[1]]]), always[used]
        out.above = self.above
        return out, used

    @cached_property
    def above(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the trees' top nodes: the turns to each id, and the log odds of going left (AFTER * trees, TOP) that counts give."""
        t, (after, always) = self.trees, self.odds
        odds = np.zeros((AFTER, *t.top.shape), _F)
        real = t.top >= 0
        odds[:, real] = always[t.top[real]]
        real &= t.top < after.shape[1]
        odds[:, real] = after[:, t.top[real]]
        return t.turn.astype(_F), odds.reshape(-1, TOP)

    def given(self, x: np.ndarray, y: np.ndarray, batch: int):
        """What of windows x with targets y (-1: none) doesn't depend on parameters, batch by batch: inputs, groups before targets, targets, and
        their choices: at top nodes (order of targets, tree by tree and then the others; where each tree's begin and the last one's end; the turns
        of those in trees, and the log odds of left to start from), and below."""
        ids, goal, rows = np.take(self.inputs, x), y.reshape(-1).astype(np.intp), batch * BLOCK
        group = np.take(self.groups, x[:, BACK:].reshape(-1))
        (turns, odds), n = self.above, len(self.trees.top)
        tree = self.trees.tree[goal].astype(np.uint16)
        key = np.repeat(np.arange(-(-len(x) // batch), dtype=np.uint16) * np.uint16(n + 1), rows)[: len(goal)] + tree
        order = np.argsort(key, kind="stable")
        at = np.bincount(key, minlength=-(-len(x) // batch) * (n + 1)).reshape(-1, n + 1).cumsum(axis=1)
        inner, begin, *each = self.choices(group, goal)
        bounds = np.searchsorted(inner, np.arange(0, len(goal) + rows, rows))
        ends = np.append(begin, len(each[0]))[bounds].tolist()
        for k, lo in enumerate(range(0, len(goal), rows)):
            some = order[lo : lo + at[k, n - 1]] if n else order[:0]
            top = np.take(turns, goal[some], axis=0, mode="clip"), np.take(odds, group[some] * n + tree[some], axis=0, mode="clip")
            i, j = bounds[k : k + 2]
            of, *others = (c[ends[k] : ends[k + 1]] for c in each)
            yield (ids[k * batch : (k + 1) * batch], group[lo : lo + rows], goal[lo : lo + rows],
                   (order[lo : lo + rows] - lo, [0, *at[k, :n].tolist()], *top), (inner[i:j] - lo, begin[i:j] - ends[k], of - i, *others))

    def choices(self, group: np.ndarray, token: np.ndarray):
        """All choices below the top nodes on the ways to tokens (-1: none) after groups, token by token: (tokens that have any; where each one's choices
        begin; and of each choice its token among those, its node, 1 for left or -1, and the log odds of left to start from)."""
        t, (after, always) = self.trees, self.odds
        size = t.size[token]
        inner = np.flatnonzero(size)
        size, token = size[inner], token[inner]
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(inner)), size)
        at = np.arange(len(of))
        at += (t.first[token] - begin)[of]
        node = t.nodes[at]
        if after.shape[1]:
            row = group[inner] * after.shape[1]
            start = np.take(after, row[of] + node, mode="clip")
        else:
            start = always[node]
        rare = np.flatnonzero(node >= after.shape[1])
        start[rare] = always[node[rare]]
        return inner, begin, of, node, t.left[at], start


def _log_shares(h: np.ndarray, top: tuple, below: tuple, w: np.ndarray, w_top: np.ndarray) -> np.ndarray:
    """Log of each token's share of its class, with hidden values h and weights w (nodes, DIM) of choices and w_top of the top ones: 0 for tokens that are a class."""
    order, at, turn, start = top
    some = order[: at[-1]]
    x = _wrong(start, turn, np.take(h, some, axis=0, mode="clip"), w_top, at)
    x *= turn
    x *= turn  # 0 off the way
    x += 1
    out = np.zeros(len(h))
    out[some] = -(np.log(x, out=x) @ np.ones(TOP, _F))
    inner, begin, of, node, left, start = below
    if len(inner):
        x = (start + _each(np.take(h, inner, axis=0, mode="clip"), of, w, node)[0]) * -left
        np.exp(_capped(x), out=x)
        out[inner] -= np.add.reduceat(np.log1p(x, out=x), begin)
    return out


def _top_weights(w: np.ndarray, trees: Trees) -> np.ndarray:
    """(trees, TOP, DIM): the weights (nodes, DIM) of the trees' top nodes."""
    return np.take(w, trees.top, axis=0, mode="clip") if len(w) else np.zeros((*trees.top.shape, DIM), w.dtype)


def _wrong(start: np.ndarray, turn: np.ndarray, h: np.ndarray, w_top: np.ndarray, at: list[int]) -> np.ndarray:
    """Odds against each token's turn at each top node of its tree; 1 off the way."""
    x = np.empty(start.shape, h.dtype)
    for w, lo, hi in zip(np.ascontiguousarray(w_top.transpose(0, 2, 1)), at, at[1:]):
        np.matmul(h[lo:hi], w, out=x[lo:hi])
    x += start
    x *= turn
    return np.exp(_capped(x), out=x)


def _capped(x: np.ndarray) -> np.ndarray:
    """x, at most 60, in place, so that its exponential is finite."""
    return np.minimum(x, x.dtype.type(60), out=x) if x.max(initial=0) > 60 else x


def _each(h: np.ndarray, of: np.ndarray, w: np.ndarray, node: np.ndarray):
    """(products, hidden values (DIM, choices), weights (DIM, choices)) of each choice."""
    h, w = (np.ascontiguousarray(np.take(x, at, axis=0, mode="clip").T) for x, at in ((h, of), (w, node)))
    return (h * w).sum(axis=0), h, w


def _across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of long arrays, in pieces."""
    n = len(a) // 256 * 256
    a, b = ((x[:n].reshape(-1, 256, x.shape[1]), x[n:]) for x in (a, b))
    return (a[0].transpose(0, 2, 1) @ b[0]).sum(axis=0) + a[1].T @ b[1]


def _summed(where: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Sums (n, m) of the columns (m, ...) that ``where`` (intp) deals to each of n rows."""
    out = np.empty((n, len(columns)), columns.dtype)
    for k, c in enumerate(columns.astype(float, order="C")):
        out[:, k] = np.bincount(where, c, n)
    return out


def initial(vocabulary: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    size = len(vocabulary.log_class)
    near = lambda *s: (r.standard_normal(s) * 0.3).astype(_F)
    return {
        "E": near(INPUTS, DIM), "m": near(DIM, DIM), "v": near(DIM, DIM),
        "U": near(DIM, size) * _F(0.1), "c": np.zeros(size, _F), "W": np.zeros((len(vocabulary.trees.low), DIM), _F), "b": -np.arange(REACH, dtype=_F) * _F(0.3),
    }


_I, _J = np.arange(BLOCK)[:, None], np.arange(BACK + BLOCK)[None, :]
_OFFSET = BACK + _I - _J  # distance of query i of the block to place j of the window
_SEEN = (_OFFSET >= 0) & (_OFFSET < REACH)
_FROM = _OFFSET[_SEEN]
_FAR = _F(-1e9)


def _bias(b: np.ndarray) -> np.ndarray:
    out = np.full(_SEEN.shape, _FAR)
    out[_SEEN] = b[_FROM]
    return out


def windows(tokens, sizes, before):
    """(inputs (n, BACK + BLOCK), targets (n, BLOCK), text of each block); places outside a text hold ``before``."""
    blocks = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), blocks)
    n = int(blocks.sum())
    target = np.full(n * BLOCK, -1, np.int32)
    first = (np.cumsum(blocks) - blocks) * BLOCK
    place = np.arange(len(tokens)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    target[place] = tokens
    shifted = np.full(n * BLOCK, before, np.int32)
    inner = np.ones(len(tokens), bool)
    ends = np.cumsum(sizes) - 1
    inner[ends[sizes > 0]] = False  # a text's last token is no input
    shifted[place[inner] + 1] = tokens[inner]
    own = shifted.reshape(n, BLOCK)
    back = np.full((n, BACK), before, np.int32)
    same = np.flatnonzero(text[1:] == text[:-1]) + 1
    back[same] = own[same - 1, -BACK:]
    return np.concatenate([back, own], axis=1), target.reshape(n, BLOCK), text


def _weights(own, keys, ids, bias):
    """Attention of each place of the block to the window, not yet divided by its sum."""
    a = own @ np.ascontiguousarray(keys.transpose(0, 2, 1))
    a += bias
    # places before a text are masked, but for the mark just before its first token
    starts = np.flatnonzero(ids[:, 0] == INPUTS - 1)
    if len(starts):
        masked = ids[starts] == INPUTS - 1
        masked[:, BACK] = False
        a[starts] = np.where(masked[:, None, :], _FAR, a[starts])
    return np.exp(_capped(a), out=a)


class Scorer:
    """Log probabilities under fixed parameters."""

    def __init__(self, p: dict[str, np.ndarray], vocabulary: Vocabulary):
        self.v, self.p = vocabulary, p
        self.before = len(vocabulary.outputs)
        self.keys, self.val = p["E"] @ p["m"], p["E"] @ p["v"]
        self.w, self.w_top = p["W"], _top_weights(p["W"], vocabulary.trees)
        self.bias = _bias(p["b"])
        self.starts = vocabulary.starts(p["c"])

    def texts(self, tokens: np.ndarray, sizes: np.ndarray, block: int = 512) -> np.ndarray:
        """Natural log probability of each text."""
        x, y, text = windows(tokens, sizes, self.before)
        out = np.zeros(len(sizes))
        take = lambda table, at: np.take(table, at, axis=0, mode="clip")
        of_block = text.tolist()
        for lo, (ids, group, goal, *choices) in zip(range(0, len(x), block), self._given(x, y, block)):
            own = take(self.p["E"], ids[:, BACK:])
            a = _weights(own, take(self.keys, ids), ids, self.bias)
            h = a @ take(self.val, ids)
            h /= np.maximum(a.reshape(-1, a.shape[2]) @ np.ones(a.shape[2], _F), _F(1e-30)).reshape(*a.shape[:2], 1)  # 0 only behind a text's end
            h += own
            h = np.maximum(h, 0, out=h).reshape(-1, DIM)
            z = h @ self.p["U"]
            z += take(self.starts, group)
            hit = z.ravel()[np.arange(len(goal)) * z.shape[1] + self.v.outputs[np.maximum(goal, 0)]]
            np.exp(z, out=z)  # logits are small: trained with a ridge and started at log frequencies
            logp = hit.astype(float) - np.log(z @ np.ones(z.shape[1], _F)) + _log_shares(h, *choices, self.w, self.w_top)
            logp[goal < 0] = 0
            first, last = of_block[lo], of_block[min(lo + block, len(x)) - 1] + 1  # texts stand in order
            out[first:last] += np.bincount(np.repeat(text[lo : lo + block] - first, BLOCK), logp, last - first)
        return out

    def _given(self, x, y, block):
        for lo in range(0, len(x), SOME * block):
            yield from self.v.given(x[lo : lo + SOME * block], y[lo : lo + SOME * block], block)


def gradients(p, v: Vocabulary, x: np.ndarray, y: np.ndarray, ready: tuple | None = None):
    """Mean log loss of subwords, and its gradients, for windows x with targets y (-1: none); no loss (nan) where what is given is ready."""
    with_loss = ready is None
    ids, group, goal, top, below = next(v.given(x, y, len(x))) if with_loss else ready
    kind = p["E"].dtype.type
    flat = lambda t: t.reshape(-1, t.shape[-1])
    e = np.take(p["E"], ids, axis=0, mode="clip")
    own = e[:, BACK:]
    k = (flat(e) @ p["m"]).reshape(e.shape)
    val = (flat(e) @ p["v"]).reshape(e.shape)
    a = _weights(own, k, ids, _bias(p["b"]))
    whole = np.maximum(flat(a) @ np.ones(a.shape[2], kind), kind(1e-30)).reshape(*a.shape[:2], 1)
    att = a @ val
    att /= whole
    h = att + own
    r = np.maximum(h, 0).reshape(-1, DIM)
    real = goal >= 0
    n = max(int(real.sum()), 1)
    z = r @ p["U"]
    z += np.take(v.starts(p["c"]), group, axis=0, mode="clip")
    np.exp(_capped(z), out=z)
    total = z @ np.ones(z.shape[1], kind)
    at = np.arange(len(goal)) * z.shape[1] + v.outputs[np.maximum(goal, 0)]
    loss = -np.log(np.maximum(z.ravel()[at[real]] / total[real], 1e-30)).sum() / n if with_loss else np.nan
    counts = (real / kind(n)).astype(kind)  # places without a target have no loss
    z *= (counts / total)[:, None]
    z.ravel()[at] -= counts
    g = {"U": _across(r, z), "c": np.ones(len(z), kind) @ z}
    dh = z @ np.ascontiguousarray(p["U"].T)
    order, at, turn, start = top
    of_top, w_top = np.take(r, order[: at[-1]], axis=0, mode="clip"), _top_weights(p["W"], v.trees)
    odds = _wrong(start, turn, of_top, w_top, at)
    if with_loss:
        loss += np.log1p(odds)[turn != 0].sum() / n
    odds += 1
    np.reciprocal(odds, out=odds)
    np.subtract(1, odds, out=odds)
    odds *= turn
    g_top, back = np.empty_like(w_top), np.zeros_like(r)
    for i, (lo, hi) in enumerate(zip(at, at[1:])):
        g_top[i] = odds[lo:hi].T @ of_top[lo:hi]
        np.matmul(odds[lo:hi], w_top[i], out=back[lo:hi])
    back[: at[-1]] /= kind(n)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    dh += np.take(back, place, axis=0, mode="clip")
    inner, begin, of, node, left, start = below
    if len(inner):
        odds, of_h, of_w = _each(np.take(r, inner, axis=0, mode="clip"), of, p["W"], node)
        odds = (odds + start) * -left
        np.exp(_capped(odds), out=odds)
        odds += 1
        if with_loss:
            loss += np.log(odds).sum() / n
        slope = (1 / odds - 1) * left / kind(n)
        of_w *= slope
        of_h *= slope
        dh[inner] += np.add.reduceat(of_w, begin, axis=1).T
        g["W"] = _summed(node, of_h, len(p["W"]))
    else:
        g["W"] = np.zeros_like(p["W"])
    on = v.trees.top >= 0
    g["W"][v.trees.top[on]] += g_top[on] / kind(n)
    dh *= r > 0
    dh = dh.reshape(h.shape)
    da = dh / whole
    ds = da @ np.ascontiguousarray(val.transpose(0, 2, 1))
    ds -= (flat(da * att) @ np.ones(DIM, kind)).reshape(whole.shape)
    ds *= a
    g["b"] = np.bincount(_FROM, (np.ones(len(ds), kind) @ ds.reshape(len(ds), -1)).reshape(ds.shape[1:])[_SEEN], REACH).astype(kind)
    dval, dk = a.transpose(0, 2, 1) @ da, ds.transpose(0, 2, 1) @ own
    g["m"], g["v"] = flat(e).T @ flat(dk), flat(e).T @ flat(dval)
    de = flat(dk) @ np.ascontiguousarray(p["m"].T)
    de += flat(dval) @ np.ascontiguousarray(p["v"].T)
    de = de.reshape(e.shape)
    dh += ds @ k
    de[:, BACK:] += dh
    g["E"] = _summed(ids.ravel(), flat(de).T, len(p["E"]))
    return loss, g


def _joined(p: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(all parameters in turn, views of each of them)."""
    flat = np.concatenate([w.ravel() for w in p.values()])
    ends = np.cumsum([w.size for w in p.values()])
    return flat, {n: flat[end - w.size : end].reshape(w.shape) for (n, w), end in zip(p.items(), ends)}


def train_locally(p, v: Vocabulary, x: np.ndarray, y: np.ndarray, rate: float, batch: int = 256, ridge: float = 1e-5):
    """Adam over the windows once, with a rate that falls to a tenth; (parameters, tokens)."""
    order = np.random.default_rng(len(x)).permutation(len(x))
    start, (v, used) = p, v.of_tokens(y[y >= 0])
    all_w, p = _joined({n: w[used] if n == "W" else w for n, w in p.items()})
    m, s = np.zeros_like(all_w), np.zeros_like(all_w)
    batch = min(batch, max(16, len(x) // 512))  # few windows: smaller batches
    steps = max(1, -(-len(x) // batch))
    for t, lo in enumerate(range(0, len(x), batch), 1):
        if t % SOME == 1:
            pick = order[lo : lo + SOME * batch]
            ready = v.given(x[pick], y[pick], batch)
        g = gradients(p, v, None, None, next(ready))[1]
        now = rate * (1 - 0.9 * (t - 1) / steps) / (1 - 0.9**t)
        d = np.concatenate([g[n].ravel() for n in p])
        d += _F(ridge) * all_w
        m *= _F(0.9)
        m += _F(0.1) * d
        d *= d
        s *= _F(0.99)
        s += _F(0.01) * d
        np.sqrt(s * _F(1 / (1 - 0.99**t)), out=d)
        d += _F(1e-6)
        all_w -= _F(now) * m / d
    p["W"], inside = start["W"].copy(), p["W"]
    p["W"][used] = inside
    return p, int((y >= 0).sum())
