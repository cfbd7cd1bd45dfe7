"""A small causal self-attention model over token ids, in numpy.

One attention layer reads windows of ``CONTEXT + STRIDE`` inputs; only the last ``STRIDE`` of a
window predict, so each token is predicted once, and sees ``CONTEXT`` inputs before it at least
where there are so many. The next id has a class and a place in it: the most frequent ids of the
corpus fill ``CLASSES`` classes of ``MEMBERS`` ids, and all others share one more class, in which
they have their share of the corpus. Probabilities of all ids sum to one after any context.
Logits start from the corpus's counts of pairs of ids; what attention adds is trained.
"""

from __future__ import annotations

import numpy as np

WIDTH = 16
CONTEXT = 8
STRIDE = 24
CLASSES = 32
MEMBERS = 32
BATCH = 64
RATE = 0.008
# Windows that are scored at once.
_WINDOWS = 128
_HIDDEN = np.float32(-1e9)


HEAD = CLASSES * MEMBERS
# Input that stands before a text. HEAD itself stands for all ids of the last class.
BEGIN = HEAD + 1
# Weight of an id's share of the corpus beside the counts after another id.
_PRIOR = 5.0


class Vocabulary:
    """Where each id stands, and the logits that counts give, from ids' counts in the corpus."""

    def __init__(self, counts: np.ndarray, end: int):
        counts = counts.astype(np.float64)
        counts[end] += 1
        order = np.argsort(-counts, kind="stable")
        head = order[:HEAD]
        self.place = np.full(len(counts), HEAD, np.int32)
        self.place[head] = np.arange(len(head))
        tail = counts + 0.1
        tail[head] = 0
        # Log probability of an id among those of the last class.
        self.tail = np.log(np.maximum(tail, 1e-9) / max(tail.sum(), 1e-9)).astype(np.float32)
        shares = np.full(HEAD + 1, 1e-6)
        shares[: len(head)] = counts[head] + 0.1
        shares[HEAD] = max(tail.sum(), 1e-6)
        self.shares = shares / shares.sum()
        self.follow(np.zeros((HEAD + 2, HEAD + 1)))

    def follow(self, pairs: np.ndarray) -> None:
        """Takes the counts of places after places; the last row is for the begin of a text."""
        p = pairs + _PRIOR * self.shares
        p /= p.sum(axis=1, keepdims=True)
        inner = p[:, :HEAD].reshape(-1, CLASSES, MEMBERS)
        sums = inner.sum(axis=2, keepdims=True)
        self.member_after = np.log(inner / sums).astype(np.float32)
        self.class_after = np.log(np.concatenate([sums[:, :, 0], p[:, HEAD:]], axis=1)).astype(np.float32)


def restored(state: dict[str, np.ndarray]) -> Vocabulary:
    """A vocabulary from its attributes, the form in which it is broadcast."""
    vocabulary = object.__new__(Vocabulary)
    vocabulary.__dict__.update(state)
    return vocabulary


def new_parameters(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def drawn(*shape: int, scale: float = 0.1) -> np.ndarray:
        return (rng.normal(size=shape) * scale).astype(np.float32)

    d = WIDTH
    return {
        # The last class is one input, and so is the begin of a text.
        "embed": drawn(HEAD + 2, d, scale=0.5),
        "where": drawn(CONTEXT + STRIDE, d),
        "query": drawn(d, d, scale=0.3),
        "key": drawn(d, d, scale=0.3),
        "value": drawn(d, d, scale=0.3),
        "out": drawn(d, d, scale=0.3),
        "class": drawn(d, CLASSES + 1, scale=0.01),
        "class_bias": drawn(CLASSES + 1, scale=0),
        "member": drawn(CLASSES, d, MEMBERS, scale=0.01),
        "member_bias": drawn(CLASSES, MEMBERS, scale=0),
    }


def flat(parameters: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parameters[k].ravel() for k in sorted(parameters)])


def unflat(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    found, at = {}, 0
    for k in sorted(like):
        found[k] = np.asarray(vector[at : at + like[k].size], np.float32).reshape(like[k].shape)
        at += like[k].size
    return found


def windows(places: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, which of them are there, and the first predicted token of each window.

    ``places`` are texts' ids one after another, ``bounds`` each text's. The input that predicts a
    text's first token is the begin of a text, the others are the tokens before.
    """
    sizes = np.diff(bounds)
    count = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(sizes)), count)
    step = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[text] + step * STRIDE
    at = first[:, None] + np.arange(-CONTEXT, STRIDE)
    there = (at >= bounds[text][:, None]) & (at < bounds[text + 1][:, None])
    goes_on = there & (at > bounds[text][:, None])
    inputs = np.where(goes_on, places[np.where(goes_on, at - 1, 0)], BEGIN)
    return inputs, there, first


_CAUSAL = np.arange(CONTEXT + STRIDE)[None, :] <= np.arange(CONTEXT, CONTEXT + STRIDE)[:, None]
_AHEAD_ONLY = np.where(_CAUSAL, np.float32(0), _HIDDEN)


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of the logits less what is taken off them, their sums, and what was taken off.

    Nothing is taken off where no sum leaves what floats hold well, as going over all logits for
    the greatest takes longer than the sums; else each row's greatest is taken off.
    """
    ones = np.ones(logits.shape[-1], logits.dtype)
    with np.errstate(over="ignore"):
        p = np.exp(logits)
        total = p @ ones
    top = np.zeros((), logits.dtype)
    if total.size and not (total.min() > 1e-30 and total.max() < 1e30):
        top = logits.max(axis=-1)
        p = np.exp(logits - top[..., None])
        total = p @ ones
    return p, total, top


def _softmax(logits: np.ndarray) -> np.ndarray:
    p, total, _ = _exp(logits)
    p *= (1 / total)[..., None]
    return p


def _log_sums(logits: np.ndarray) -> np.ndarray:
    _, total, top = _exp(logits)
    return np.log(total) + top


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the targets by class, the classes in that order, and how many are not of the last class."""
    group = targets // MEMBERS
    order = np.argsort(group.astype(np.uint8), kind="stable")
    group = group[order]
    return order, group, int(np.searchsorted(group, CLASSES))


def _class_logits(m: dict[str, np.ndarray], after: np.ndarray, rows: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Logits of the classes; ``after`` has what each place adds to those of the next."""
    logits = rows @ m["class"]
    logits += after.take(last, axis=0)
    return logits


def _inner(m: dict[str, np.ndarray], after: np.ndarray, rows: np.ndarray, last: np.ndarray, group: np.ndarray):
    """Logits of the members of each row's class, rows in the order of classes; and each class's rows."""
    edges = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    parts = [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]
    inner = np.empty((len(rows), MEMBERS), rows.dtype)
    member = m["member"]
    for c, own in parts:
        np.dot(rows[own], member[c], out=inner[own])
    inner += after.reshape(-1, MEMBERS).take(last * CLASSES + group, axis=0)
    return inner, parts


def _attend(m: dict[str, np.ndarray], inputs: np.ndarray, there: np.ndarray):
    """Inputs, their queries for keys that are the inputs themselves, weights, and what they add up to.

    As query and key meet in one product, and so do value and out, each pair is one matrix here.
    """
    x = m["embed"].take(inputs, axis=0)
    x += m["where"]
    ahead = np.ascontiguousarray(x[:, CONTEXT:])
    meet = (m["query"] @ m["key"].T) * np.float32(WIDTH**-0.5)
    q = (ahead.reshape(-1, WIDTH) @ meet).reshape(ahead.shape)
    scores = q @ x.transpose(0, 2, 1)
    scores += _AHEAD_ONLY
    # Tokens see none that is not there but those before the text's first, in its first window.
    # An input sees itself at least, so rows that are not there have a sum too.
    begins = np.flatnonzero(~there[:, 0])
    if len(begins):
        scores[begins, :, :CONTEXT] += np.where(there[begins, None, :CONTEXT], np.float32(0), np.float32(-1e4))
    weights = _softmax(scores)
    mixed = weights @ x
    h = (mixed.reshape(-1, WIDTH) @ (m["value"] @ m["out"])).reshape(ahead.shape)
    h += ahead
    return x, ahead, q, weights, mixed, h


def log_probabilities(m: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log probability of each id after those before it in its text."""
    if not len(ids):
        return np.zeros(0)
    places = vocabulary.place[ids]
    inputs, there, first = windows(places, bounds)
    class_after, member_after = vocabulary.class_after + m["class_bias"], vocabulary.member_after + m["member_bias"]
    found = np.empty(len(ids))
    # Few windows at once, so that what they need stays near the processor. They follow each
    # other as the texts do, so their rows are in the order of the ids.
    for a in range(0, len(inputs), _WINDOWS):
        part = slice(a, a + _WINDOWS)
        at = np.flatnonzero(there[part, CONTEXT:])
        own = slice(first[a], first[a] + len(at))
        order, group, heads = _by_class(places[own])
        at, target = at[order], places[own][order]
        rows = _attend(m, inputs[part], there[part])[-1].reshape(-1, WIDTH).take(at, axis=0)
        last = inputs[part, CONTEXT:].ravel().take(at)
        logits = _class_logits(m, class_after, rows, last)
        log = logits.ravel().take(np.arange(0, logits.size, CLASSES + 1) + group) - _log_sums(logits)
        inner, _ = _inner(m, member_after, rows[:heads], last[:heads], group[:heads])
        member = np.arange(0, inner.size, MEMBERS) + target[:heads] % MEMBERS
        log[:heads] += inner.ravel().take(member) - _log_sums(inner)
        log[heads:] += vocabulary.tail[ids[own][order[heads:]]]
        found[own][order] = log
    return found


def gradients(m: dict[str, np.ndarray], vocabulary: Vocabulary, inputs, there, targets, g=None) -> dict[str, np.ndarray]:
    """Gradients of the mean loss of the predicted tokens; ``targets`` has one for each input there.

    They are written into the arrays of ``g``, if given.
    """
    g = g or {name: np.empty_like(a) for name, a in m.items()}
    x, ahead, q, weights, mixed, h = _attend(m, inputs, there)
    order, group, heads = _by_class(targets)
    at = np.flatnonzero(there[:, CONTEXT:])[order]
    rows, last = h.reshape(-1, WIDTH).take(at, axis=0), inputs[:, CONTEXT:].ravel().take(at)
    scale = h.dtype.type(1 / max(1, len(rows)))
    p = _softmax(_class_logits(m, vocabulary.class_after + m["class_bias"], rows, last))
    p.ravel()[np.arange(0, p.size, CLASSES + 1) + group] -= 1
    p *= scale
    np.matmul(rows.T, p, out=g["class"])
    np.matmul(np.ones(len(p), p.dtype), p, out=g["class_bias"])
    d_rows = p @ m["class"].T
    inner, parts = _inner(m, vocabulary.member_after, rows[:heads], last[:heads], group[:heads])
    inner += m["member_bias"].take(group[:heads], axis=0)
    p = _softmax(inner)
    p.ravel()[np.arange(0, p.size, MEMBERS) + targets[order[:heads]] % MEMBERS] -= 1
    p *= scale
    g["member"][:] = 0
    g["member_bias"][:] = 0
    if parts:
        member, d_member, ahead_of = m["member"], g["member"], np.empty_like(rows[:heads])
        for c, own in parts:
            np.dot(rows[own].T, p[own], out=d_member[c])
            np.dot(p[own], member[c].T, out=ahead_of[own])
        g["member_bias"][[c for c, _ in parts]] = np.add.reduceat(p, [own.start for _, own in parts], axis=0)
        d_rows[:heads] += ahead_of
    d_flat = np.zeros_like(h).reshape(-1, WIDTH)
    d_flat[at] = d_rows
    # Of the product of value and out, and of that of query and key, come those of each.
    d_product = mixed.reshape(-1, WIDTH).T @ d_flat
    np.matmul(d_product, m["out"].T, out=g["value"])
    np.matmul(m["value"].T, d_product, out=g["out"])
    d_mixed = (d_flat @ (m["value"] @ m["out"]).T).reshape(h.shape)
    d_scores = d_mixed @ x.transpose(0, 2, 1)
    # What the weights' own sum takes off is the same sum over what they mix.
    d_scores -= np.einsum("nsd,nsd->ns", d_mixed, mixed)[..., None]
    d_scores *= weights
    d_q = (d_scores @ x).reshape(-1, WIDTH)
    root = np.float32(WIDTH**-0.5)
    d_product = (ahead.reshape(-1, WIDTH).T @ d_q) * root
    np.matmul(d_product, m["key"], out=g["query"])
    np.matmul(d_product.T, m["query"], out=g["key"])
    d_x = weights.transpose(0, 2, 1) @ d_mixed
    d_x += d_scores.transpose(0, 2, 1) @ q
    d_ahead = d_q @ (m["key"] @ m["query"].T * root)
    d_ahead += d_flat
    d_x[:, CONTEXT:] += d_ahead.reshape(h.shape)
    np.sum(d_x, axis=0, out=g["where"])
    sums = np.bincount((inputs.ravel()[:, None] * WIDTH + np.arange(WIDTH)).ravel(), d_x.ravel(), g["embed"].size)
    g["embed"][:] = sums.reshape(g["embed"].shape)
    return g


class Trainer:
    """Adam steps over batches of windows."""

    def __init__(self, parameters: dict[str, np.ndarray], vocabulary: Vocabulary):
        # All parameters lie in one array, and so do their gradients.
        self.all, self.vocabulary = flat(parameters), vocabulary
        self.first, self.second, self.change = (np.zeros_like(self.all) for _ in range(3))
        self.gradient = np.zeros_like(self.all)
        self.m, self.g = unflat(self.all, parameters), unflat(self.gradient, parameters)
        self.steps = 0
        self.tokens = 0

    def learn(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        places = self.vocabulary.place[ids]
        inputs, there, first = windows(places, bounds)
        order = np.random.default_rng(self.steps).permutation(len(inputs))
        for a in range(0, len(order), BATCH):
            part = np.sort(order[a : a + BATCH])
            at = (first[part, None] + np.arange(STRIDE))[there[part, CONTEXT:]]
            gradients(self.m, self.vocabulary, inputs[part], there[part], places[at], self.g)
            self._step()
            self.tokens += len(at)

    def _step(self) -> None:
        self.steps += 1
        rate = RATE * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        g, change = self.gradient, self.change
        g *= np.float32(0.1)
        self.first *= np.float32(0.9)
        self.first += g
        # A hundredth of the gradient's square.
        g *= g
        self.second *= np.float32(0.99)
        self.second += g
        np.sqrt(self.second, out=change)
        change += np.float32(1e-6)
        np.divide(self.first, change, out=change)
        change *= np.float32(rate)
        self.all -= change
