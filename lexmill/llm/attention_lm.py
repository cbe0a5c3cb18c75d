"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

Three passes over the corpus.  The first turns every text into subword ids, written once and read by the
others, and counts words and ids of the training documents.  The second trains: a warm start on the driver is
sent to every task; documents are dealt by a hash into buckets of about a million ids, each bucket's learner
goes on from the warm start over all its windows, and the weights are averaged by the windows seen.  Neither
buckets nor the order within them hang on how the table is partitioned, so the model does not either.  The
third scores every document.

The model reads windows of 32 ids, the last 28 of which are predicted; windows overlap by 4, so each id is
predicted once, with 4 to 31 ids of context (fewer at a document's start).  One layer of causal attention with a
learned bias for each distance gives the state from which an id's class and its place in the class are
predicted, two softmaxes of 32; ids beyond the 992 most frequent share a place, by their smoothed counts.  Keys and
values are the inputs themselves: their matrices are taken in by those of queries and outputs.

``attention_score`` is the log10 probability of a document's ids under this layer.  ``score`` adds a memory of
the training documents in stretches of two windows, which a passage that occurs elsewhere in the corpus is known by:
where the eight ids before a stretch stand before one in n other training documents, m of which go on with the very
same ids, the stretch's probability is n / (n + 1) * m / n + 1 / (n + 1) times that of the layer.  Documents are counted,
not stretches, and never the document itself, so what a document repeats in itself adds nothing.  Where nothing else in
the corpus agrees, the two scores are the same.

Contract: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and every document ends with one end token; null
and empty texts are that token alone.  A null doc_id is in no training set and its held_out is null.  Without
training documents all counts are 0 and the model is the one that training starts from.  Repeated rows are
scored each.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, cut, give_back_memory, keep_freed_memory, slices, text_batches
from .subword import _Rows, _Store, byte_alphabet, flat, lengths_to_bounds

CONTEXT, SCORED = 4, 28
WINDOW = CONTEXT + SCORED
CLASSES = MEMBERS = 32
SLOTS = CLASSES * MEMBERS
DIM = 16
#: Ids of a stretch that is remembered, and of what comes before it.
STRETCH, BEFORE = 2 * SCORED, 8
#: Documents of the warm start, and how often it goes over them.
WARM_DOCUMENTS, WARM_ROUNDS = 400, 3
#: Ids of a bucket that one learner goes over.
BUCKET_IDS = 1_000_000
#: Most tasks that buckets are dealt to; beyond it a task has several.
MOST_TASKS = 8192
#: Windows of a training step and of a scoring step.
STEP, BATCH = 512, 512
#: Windows that go through the layer together: their arrays stay in a core's cache, their products need no packing.
BLOCK = 64
#: Words whose counts are sent to all executors (16 bytes each); rarer words' counts are joined by a shuffle.
MOST_SENT = 500_000
SHAPES = {
    "e": (SLOTS, DIM), "p": (WINDOW, DIM), "q": (DIM, DIM), "o": (DIM, DIM), "r": (WINDOW,), "u": (CLASSES, DIM), "b": (CLASSES,), "m": (CLASSES, MEMBERS, DIM), "c": (CLASSES, MEMBERS),
}
_SCALE = np.float32(DIM**-0.5)
_CAUSAL_WEIGHT = (np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)
_DISTANCE = np.maximum(np.arange(CONTEXT, WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0)
_LOG2E = np.float32(1 / np.log(2))
#: Pre-tokens of byte_bpe_50k.json over lower-cased Latin-1 words with a space before each, and text that it fits.
PRETOKENS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[a-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+| ?[^\sa-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+")
_LATIN = re.compile(r"[\x20-\x7e\xa1-\xff]*")
_SPELLING = byte_alphabet()
_U = np.uint64
_BITS = MEMBERS.bit_length() - 1
_ONES = np.ones(WINDOW, np.float32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class RunHashes:
    """64-bit hashes of runs of ids, all from one running sum of powers: a run costs a difference and a product.

    Powers of an odd number have inverses modulo 2^64, so a run's hash does not hang on where it stands.
    """

    POWER = 0x9E3779B97F4A7C15
    INVERSE = pow(POWER, -1, 1 << 64)
    _powers = [np.ones(1, _U), np.ones(1, _U)]

    def __init__(self, ids: np.ndarray) -> None:
        while len(self._powers[0]) < len(ids) + 1:
            for i, r in enumerate((self.POWER, self.INVERSE)):
                held = self._powers[i]
                self._powers[i] = np.concatenate([held, held * _U(pow(r, len(held), 1 << 64))])
        self.inverse = self._powers[1]
        mixed = _mixed(np.arange(1, int(ids.max(initial=0)) + 2, dtype=_U))
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed[ids] * self._powers[0][: len(ids)], dtype=_U)])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stops] - self.sums[starts]) * self.inverse[starts] + (stops - starts).astype(_U)).view(np.int64)


class Counts:
    """Counts by 64-bit hash: sorted, and looked up from where the hash's first bits say."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.numbers = hashes[order], numbers[order]
        self.bits = len(hashes).bit_length() + 1  # most parts have one hash or none
        edges = (np.arange(1 << self.bits) - (1 << (self.bits - 1))) << (64 - self.bits)
        self.first = np.append(np.searchsorted(self.hashes, edges), len(hashes)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def of(self, h: np.ndarray) -> np.ndarray:
        """The count of each hash, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        part = (h >> (64 - self.bits)) + (1 << (self.bits - 1))
        at, stop = self.first.take(part), self.first.take(part + 1)
        # the first of each part for all, though it may be another's; what is not met there goes on
        place = np.minimum(at, len(self.hashes) - 1)
        hit = self.hashes.take(place) == h
        out = np.where(hit, self.numbers.take(place), -1)
        left = np.flatnonzero(~hit & (at + 1 < stop))
        for i in range(1, self.most):
            place = at[left] + i
            hit = self.hashes[place] == h[left]
            out[left[hit]] = self.numbers[place[hit]]
            left = left[~hit & (place + 1 < stop[left])]
        return out


class WordIds:
    """Word -> subword ids of " " + word, by a byte-level BPE file of the ``tokenizers`` library; bounded."""

    def __init__(self, path: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.end = vocab["<|endoftext|>"]
        #: ids that begin with the space before a word: just the first id of every word is one
        self.starts = np.zeros(self.size, bool)
        for token, i in vocab.items():
            self.starts[i] = token.startswith("Ġ")
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.rows, self.store = _Rows({b"": 0}, 1), _Store(np.int32)  # row 0: no word
        self.store.append(np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([e.ids for e in self.tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False)])

    def _resolve(self) -> None:
        pending = [w.decode("utf-8", "replace") for w in self.rows.taken()]
        for i in range(0, len(pending), 4000):
            some = pending[i : i + 4000]
            joined = " " + " ".join(some)
            if len(joined.split()) == len(some):  # no other white space in them
                if _LATIN.fullmatch(joined):
                    # cut here as the library cuts, and spelled in its bytes' alphabet, so that its model alone does the rest
                    pieces = "\n".join(PRETOKENS.findall(joined)).encode().decode("latin-1").translate(_SPELLING).split(_SPELLING[10])
                    ids = np.array([t.id for x in pieces for t in self.model.tokenize(x)], np.int32)
                else:
                    ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, np.int32)
                at = np.flatnonzero(self.starts[ids])
                if len(at) == len(some):
                    self.store.append(ids, np.diff(at, append=len(ids)))
                    continue
            self.store.append(*self._encode(some))

    def rows_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words of the texts, and words of each text; call ``full`` before and ``clear`` if it says so."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
        coded = pc.dictionary_encode(words.flatten())
        keys = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        rows = np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))[coded.indices.to_numpy()]
        self._resolve()
        counts = pc.list_value_length(words).to_numpy().astype(np.int64)
        real = rows > 0
        counts = np.diff(lengths_to_bounds(real)[lengths_to_bounds(counts)])
        return rows[real], counts

    def full(self) -> bool:
        return len(self.rows) > self.most

    def documents(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents with an end after each, and their bounds."""
        ids, per_word = self.store.gather(rows)
        bounds = lengths_to_bounds(per_word)[lengths_to_bounds(counts)]
        return np.insert(ids, bounds[1:], self.end), bounds + np.arange(len(bounds))


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def without_words(path: str) -> WordIds:
    """This worker's, without the words it has encoded: later passes do not ask for them, and executors' memory is short."""
    words = word_ids(path)
    if len(words.rows) > 1:
        words.clear()
        give_back_memory()
    return words


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window the position of its first predicted id and the bounds of its document."""
    n = -(-np.diff(bounds) // SCORED)
    first = np.repeat(bounds[:-1], n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first + number * SCORED, first, np.repeat(bounds[1:], n)


def slots_of(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Slot (class * MEMBERS + member) of each id.

    The most frequent ids have one of their own, ids that start a word and others in classes apart; the last
    member of every class stands for a share of all other ids.
    """
    own = SLOTS - CLASSES
    order = np.argsort(-counts, kind="stable")
    top, rest = order[:own], order[own:]
    lined = np.concatenate([top[starts[top]], top[~starts[top]]])
    place = np.arange(len(lined))
    out = np.empty(len(counts), np.int32)
    out[lined] = place // (MEMBERS - 1) * MEMBERS + place % (MEMBERS - 1)
    out[rest] = np.arange(len(rest)) % CLASSES * MEMBERS + MEMBERS - 1
    return out


def _by_class(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by class, and where each class begins in it."""
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    return order, np.searchsorted(classes[order], np.arange(CLASSES + 1))


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    """Each value ``width`` times in a row of its own: faster than numpy's loops over short rows."""
    return np.repeat(x, width).reshape(-1, width)


def _within(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Those of the ascending numbers that are in a block, counted from its beginning."""
    a, b = np.searchsorted(x, (lo, hi)) if len(x) else (0, 0)
    return x[a:b] - lo


class AttentionLm:
    """One causal self-attention layer over id slots, predicting an id's class and its member there."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray, end: int, seed: int = 3) -> None:
        self.slot = slots_of(counts, starts)
        self.end_slot = int(self.slot[end])
        mass = np.bincount(self.slot, counts + 0.1, SLOTS) + 1e-9
        #: log share of an id in its slot
        self.within = np.log((counts + 0.1) / mass[self.slot]).astype(np.float32)
        rng = np.random.default_rng(seed)
        scale = {"e": 0.3, "p": 0.1, "u": 0.3, "m": 0.3, "o": 0.3 * DIM**-0.5, "r": 0.0}
        self.w = {n: (rng.standard_normal(s) * scale.get(n, DIM**-0.5)).astype(np.float32) for n, s in SHAPES.items()}
        of_class = mass.reshape(CLASSES, MEMBERS).sum(axis=1)
        self.w["b"] = np.log(of_class / of_class.sum()).astype(np.float32)
        self.w["c"] = np.log(mass.reshape(CLASSES, MEMBERS) / of_class[:, None]).astype(np.float32)

    def framed(self, ids: np.ndarray) -> np.ndarray:
        """Slots of the ids, with ends before and after them that windows may reach over."""
        out = np.full(CONTEXT + 1 + len(ids) + SCORED, self.end_slot, np.int32)
        out[CONTEXT + 1 : CONTEXT + 1 + len(ids)] = self.slot[ids]
        return out

    def gathered(self, framed: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (B, WINDOW), slots (B * SCORED) to predict, windows that begin a document and places past a document's end.

        The input before an id is the id before it, an end at the start.
        """
        step = framed.strides[0]
        rows = np.lib.stride_tricks.as_strided(framed, (len(framed) - WINDOW, WINDOW + 1), (step, step))[at]
        begin = np.flatnonzero(at == low)
        rows[begin, CONTEXT] = self.end_slot
        short = np.flatnonzero(high - at < SCORED)
        beyond = np.arange(SCORED) >= (high - at)[short, None]
        return rows[:, :WINDOW], rows[:, CONTEXT + 1 :].ravel(), begin, (short[:, None] * SCORED + np.arange(SCORED))[beyond]

    def prepared(self) -> dict[str, np.ndarray]:
        """The weights as blocks take them: logits are for powers of two, and biases are factors of these powers.

        Biases then cost nothing: sums of powers are products with them, and so are the slopes' sums.  ``clip`` says
        whether any logit can be beyond what keeps powers finite, by the lengths of the weights' rows.
        """
        w = self.w
        longest = lambda t: float(np.sqrt(np.einsum("...d,...d->...", t, t).max()))
        x = longest(w["e"]) + longest(w["p"])
        out = x * (1 + np.linalg.norm(w["o"])) * max(longest(w["u"]), longest(w["m"]))
        return {
            "clip": not (x * x * np.linalg.norm(w["q"]) * _SCALE < 29 and out < 59),
            "e": w["e"], "p": w["p"], "q": w["q"] * (_SCALE * _LOG2E), "o": w["o"], "r": np.exp2(w["r"] * _LOG2E)[_DISTANCE] * _CAUSAL_WEIGHT,
            "u": np.ascontiguousarray(w["u"].T * _LOG2E), "b": np.exp(w["b"]), "m": np.ascontiguousarray(w["m"].transpose(0, 2, 1) * _LOG2E), "c": np.exp(w["c"]),
        }

    @staticmethod
    def layer(w: dict[str, np.ndarray], inputs: np.ndarray, begin: np.ndarray, h: np.ndarray) -> tuple:
        """Into ``h`` the states of a block of windows; ``begin`` has those that have nothing before their first id."""
        x = np.take(w["e"], inputs, axis=0)
        x += w["p"]
        xs = np.ascontiguousarray(x[:, CONTEXT:]).reshape(-1, DIM)
        xt = np.ascontiguousarray(x.transpose(0, 2, 1))
        q = xs @ w["q"]
        s = q.reshape(-1, SCORED, DIM) @ xt
        if w["clip"]:
            np.minimum(s, 30 * _LOG2E, out=s)  # powers stay finite without a row maximum
        np.exp2(s, out=s)
        s *= w["r"]
        if len(begin):
            s[begin, :, :CONTEXT] = 0
        inverse = _wide(1 / np.maximum(s.reshape(-1, WINDOW) @ _ONES, np.float32(1e-20)), DIM)
        a = (s @ x).reshape(-1, DIM)
        a *= inverse
        np.matmul(a, w["o"], out=h)
        h += xs
        return x, xt, xs, q, s, inverse, a

    def log_probs(self, framed: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Positions predicted in these windows, and the natural log probability of the slot at each."""
        inputs, wanted, begin, absent = self.gathered(framed, at, low, high)
        of_class, member = wanted >> _BITS, wanted & (MEMBERS - 1)
        h, out = np.empty((len(wanted), DIM), np.float32), np.empty(len(wanted), np.float32)
        place = np.arange(len(wanted)) * CLASSES

        def logs(z: np.ndarray, lo: int, hi: int, want: np.ndarray) -> np.ndarray:
            """Logits of the slots wanted; what is left in ``z`` are powers."""
            picked = z.ravel().take(place[: hi - lo] + want[lo:hi])
            if w["clip"]:
                np.minimum(z, 80 * _LOG2E, out=z)
                np.minimum(picked, 80 * _LOG2E, out=picked)
            np.exp2(z, out=z)
            return picked

        for i in range(0, len(at), BLOCK):
            lo, hi = i * SCORED, min(i + BLOCK, len(at)) * SCORED
            self.layer(w, inputs[i : i + BLOCK], _within(begin, i, i + BLOCK), h[lo:hi])
            z = h[lo:hi] @ w["u"]
            out[lo:hi] = logs(z, lo, hi, of_class)
            out[lo:hi] -= np.log2(z @ w["b"])
        order, first = _by_class(of_class)
        members, hs, total = member[order], np.take(h, order, axis=0), np.empty(len(order), np.float32)
        more = np.empty(len(order), np.float32)
        for i in range(0, CLASSES, 4):
            lo, hi = first[i], first[i + 4]
            z = np.empty((hi - lo, MEMBERS), np.float32)
            for j in range(i, i + 4):
                np.matmul(hs[first[j] : first[j + 1]], w["m"][j], out=z[first[j] - lo : first[j + 1] - lo])
            more[lo:hi] = logs(z, lo, hi, members)
            for j in range(i, i + 4):
                np.matmul(z[first[j] - lo : first[j + 1] - lo], w["c"][j], out=total[first[j] : first[j + 1]])
        more -= np.log2(total)
        out[order] += more
        out /= _LOG2E
        out += (self.w["b"][:, None] + self.w["c"]).ravel()[wanted]
        positions = (at[:, None] + np.arange(SCORED)).ravel()
        return (np.delete(positions, absent), np.delete(out, absent)) if len(absent) else (positions, out)

    def log_probs_of(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For every id of the documents its natural log probability."""
        at, low, high = windows(bounds)
        framed, out, w = self.framed(ids), np.zeros(len(ids), np.float32), self.prepared()
        for i in range(0, len(at), BATCH):
            place, values = self.log_probs(framed, at[i : i + BATCH], low[i : i + BATCH], high[i : i + BATCH], w)
            out[place] = values
        out += self.within[ids]
        return out

    def gradients(self, framed: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean loss over the ids predicted in these windows."""
        w, p = self.w, self.prepared()
        inputs, wanted, begin, absent = self.gathered(framed, at, low, high)
        of_class, member = wanted >> _BITS, wanted & (MEMBERS - 1)
        n = np.float32(max(len(wanted) - len(absent), 1))
        h, dh, place = np.empty((len(wanted), DIM), np.float32), np.empty((len(wanted), DIM), np.float32), np.arange(len(wanted)) * CLASSES
        g = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
        loss = 0.0

        def slopes(z: np.ndarray, total: np.ndarray, at_want: np.ndarray, factor: np.ndarray, absent: np.ndarray) -> np.ndarray:
            """In place of powers the slopes of their softmax, but for the factors of the biases and those of the rows, which are returned.

            Rows that are ``absent`` have none.
            """
            nonlocal loss
            scale, powers = 1 / (n * total), z.ravel()
            picked, part = powers.take(at_want), total / factor
            logs = np.log(picked / part + 1e-30)
            if len(absent):
                scale[absent] = logs[absent] = 0
            powers[at_want] = picked - part
            loss -= float(logs.sum()) / n
            return scale

        blocks, u = [], w["u"] * p["b"][:, None]
        for i in range(0, len(at), BLOCK):
            lo, hi = i * SCORED, min(i + BLOCK, len(at)) * SCORED
            blocks.append(self.layer(p, inputs[i : i + BLOCK], _within(begin, i, i + BLOCK), h[lo:hi]))
            z = h[lo:hi] @ p["u"]
            if p["clip"]:
                np.minimum(z, 60 * _LOG2E, out=z)
            np.exp2(z, out=z)
            scale = slopes(z, z @ p["b"], place[: hi - lo] + of_class[lo:hi], p["b"][of_class[lo:hi]], _within(absent, lo, hi))
            wide = _wide(scale, DIM)
            g["u"] += z.T @ (h[lo:hi] * wide)
            g["b"] += scale @ z
            np.matmul(z, u, out=dh[lo:hi])
            dh[lo:hi] *= wide
        g["u"] *= p["b"][:, None]
        g["b"] *= p["b"]

        real = np.delete(np.arange(len(wanted)), absent) if len(absent) else None
        order, first = _by_class(of_class if real is None else of_class[real])
        order = order if real is None else real[order]
        hs, at_want, factors = np.take(h, order, axis=0), place[: len(order)] + member[order], p["c"].ravel()[wanted[order]]
        more, total, m = np.zeros((len(order) + 1, DIM), np.float32), np.empty(len(order), np.float32), w["m"] * p["c"][:, :, None]
        none = absent[:0]
        for i in range(0, CLASSES, 4):
            lo, hi = first[i], first[i + 4]
            z = np.empty((hi - lo, MEMBERS), np.float32)
            for j in range(i, i + 4):
                np.matmul(hs[first[j] : first[j + 1]], p["m"][j], out=z[first[j] - lo : first[j + 1] - lo])
            if p["clip"]:
                np.minimum(z, 60 * _LOG2E, out=z)
            np.exp2(z, out=z)
            for j in range(i, i + 4):
                np.matmul(z[first[j] - lo : first[j + 1] - lo], p["c"][j], out=total[first[j] : first[j + 1]])
            scale = slopes(z, total[lo:hi], at_want[lo:hi] - lo * MEMBERS, factors[lo:hi], none)
            wide = _wide(scale, DIM)
            hs[lo:hi] *= wide
            for j in range(i, i + 4):
                some, rows = z[first[j] - lo : first[j + 1] - lo], slice(first[j], first[j + 1])
                np.matmul(some.T, hs[rows], out=g["m"][j])
                np.matmul(scale[first[j] - lo : first[j + 1] - lo], some, out=g["c"][j])
                np.matmul(some, m[j], out=more[rows])
            more[lo:hi] *= wide
        g["m"] *= p["c"][:, :, None]
        g["c"] *= p["c"]
        back = np.full(len(wanted), len(order))
        back[order] = np.arange(len(order))

        qt, ot, by_distance = w["q"].T * _SCALE, np.ascontiguousarray(w["o"].T), np.zeros((SCORED, WINDOW), np.float32)
        dx_all = np.empty((len(at), WINDOW, DIM), np.float32)
        for i in range(0, len(at), BLOCK):
            lo, hi = i * SCORED, min(i + BLOCK, len(at)) * SCORED
            x, xt, xs, q, s, inverse, a = blocks[i // BLOCK]
            d, dx = dh[lo:hi], dx_all[i : i + BLOCK]
            d += np.take(more, back[lo:hi], axis=0)
            g["o"] += a.T @ d
            da = d @ ot
            da *= inverse
            ds = da.reshape(-1, SCORED, DIM) @ xt
            ds -= _wide(np.einsum("nd,nd->n", da, a), WINDOW).reshape(ds.shape)  # the mean of ds under s
            ds *= s
            by_distance += ds.sum(axis=0)
            q *= 1 / _LOG2E
            np.matmul(s.transpose(0, 2, 1), da.reshape(-1, SCORED, DIM), out=dx)
            dx += ds.transpose(0, 2, 1) @ q.reshape(-1, SCORED, DIM)
            dq = (ds @ x).reshape(-1, DIM)
            g["q"] += xs.T @ dq
            d += dq @ qt
            dx[:, CONTEXT:] += d.reshape(-1, SCORED, DIM)
            g["p"] += dx.sum(axis=0)
        g["q"] *= _SCALE
        g["r"] += np.bincount(_DISTANCE.ravel(), by_distance.ravel(), WINDOW)
        # sums by slot: those of a class are a product with the places of the members
        inputs = inputs.ravel()
        order, first = _by_class(inputs >> _BITS)
        members, dx = (inputs & (MEMBERS - 1))[order] + np.arange(len(order)) * MEMBERS, dx_all.reshape(-1, DIM)
        for i in range(0, CLASSES, 4):
            lo, hi = first[i], first[i + 4]
            some, chosen = np.take(dx, order[lo:hi], axis=0), np.zeros((hi - lo, MEMBERS), np.float32)
            chosen.ravel()[members[lo:hi] - lo * MEMBERS] = 1
            for j in range(i, i + 4):
                rows = slice(first[j] - lo, first[j + 1] - lo)
                np.matmul(chosen[rows].T, some[rows], out=g["e"][j * MEMBERS : (j + 1) * MEMBERS])
        return g, loss

    def pack(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in SHAPES])

    def unpack(self, values: np.ndarray) -> None:
        at = 0
        for n, s in SHAPES.items():
            size = int(np.prod(s))
            self.w[n] = values[at : at + size].reshape(s).astype(np.float32)
            at += size


class Learner:
    """Adam steps over windows of documents that arrive piece by piece, STEP windows to a step."""

    def __init__(self, model: AttentionLm, rate: float) -> None:
        self.model, self.rate, self.t, self.seen = model, rate, 0, 0
        self.m = {n: np.zeros(s, np.float32) for n, s in SHAPES.items()}
        self.s = {n: np.zeros(s, np.float32) for n, s in SHAPES.items()}

    def step(self, framed: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        g, _ = self.model.gradients(framed, at, low, high)
        self.t += 1
        self.seen += len(at)
        rate = self.rate / (1 + self.t / 400) * len(at) / STEP
        for n, v in g.items():
            self.m[n] += 0.1 * (v - self.m[n])
            self.s[n] += 0.01 * (v * v - self.s[n])
            self.model.w[n] -= np.float32(rate) * (self.m[n] / (1 - 0.9**self.t)) / (np.sqrt(self.s[n] / (1 - 0.99**self.t)) + np.float32(1e-8))

    def run(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Steps over all windows of the documents, each step spread over all of these."""
        at, low, high = windows(bounds)
        framed, n = self.model.framed(ids), -(-len(at) // STEP)
        for i in range(n):
            self.step(framed, at[i::n], low[i::n], high[i::n])


def training(documents: DataFrame) -> DataFrame:
    return documents.where(crc32_mod("doc_id", 7) != 2)


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, learn, ids) of all documents; of training documents also counts (h, n) by word and (id, n) by id.

    Each task adds up what it has read in a bounded cache and hands on one row for each entry; id -1 counts
    documents.  ``h`` is the hash of a word's ids.
    """
    text_batches(documents.sparkSession)
    id_type = documents.schema["doc_id"].dataType
    arrow = {"learn": pa.bool_(), "ids": pa.binary(), "h": pa.int64(), "id": pa.int32(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        words = word_ids(path)  # kept from task to task; only the counts begin anew
        seen, ids_seen, n_documents = np.zeros(1024, np.int64), np.zeros(words.size, np.int64), 0

        def rows(id_kind: pa.DataType, size: int, **columns: pa.Array) -> pa.RecordBatch:
            columns.setdefault("doc_id", pa.nulls(size, id_kind))
            names = ["doc_id", *arrow]
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, arrow[c]) for c in names], names=names)

        def words_seen(id_kind: pa.DataType) -> pa.RecordBatch:
            some = np.flatnonzero(seen[: len(words.rows)])
            ids, lengths = words.store.gather(some)
            stops = np.cumsum(lengths)
            return rows(id_kind, len(some), h=pa.array(RunHashes(ids).of(stops - lengths, stops)), n=pa.array(seen[some]))

        kind = None
        for batch in slices(batches, 1024, 2 << 20):
            kind = batch.column(0).type
            if words.full():
                yield words_seen(kind)
                words.clear()
                seen[:] = 0
            of_words, counts = words.rows_of(batch.column(2))
            while len(seen) < len(words.rows):
                seen = np.concatenate([seen, np.zeros_like(seen)])
            ids, bounds = words.documents(of_words, counts)
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            taken = of_words if learn.all() else of_words[np.repeat(learn, counts)]
            got = np.bincount(taken, minlength=1)
            seen[: len(got)] += got
            ids_seen += np.bincount(ids[np.repeat(learn, np.diff(bounds))], minlength=words.size)
            n_documents += int(learn.sum())
            raw, wide = memoryview(ids.astype(words.dtype)).cast("B"), words.dtype.itemsize
            cuts = (bounds * wide).tolist()
            packed = pa.array([bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())
            yield rows(kind, len(learn), doc_id=batch.column(0), learn=batch.column(1), ids=packed)
        if n_documents:
            yield words_seen(kind)
            some = np.append(np.flatnonzero(ids_seen), -1)
            yield rows(kind, len(some), id=pa.array(some.astype(np.int32)), n=pa.array(np.append(ids_seen[some[:-1]], n_documents)))

    learn = F.coalesce(crc32_mod("doc_id", 7) != 2, F.lit(False)).alias("learn")
    return documents.select("doc_id", learn, "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, learn boolean, ids binary, h long, id int, n long")


def _documents(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of packed documents one after the other, as they lie in the column, and their bounds."""
    _, offsets, values = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    ids = np.frombuffer(values or b"", np.uint8)[bounds[0] : bounds[-1]].view(dtype)
    return ids, (bounds - bounds[0]) // dtype.itemsize


def trained(documents: DataFrame, path: str, counts: np.ndarray, warm_documents: int = WARM_DOCUMENTS, bucket_ids: int = BUCKET_IDS) -> AttentionLm:
    """The model after the warm start and one pass over all training documents; ``documents`` as ``encoded`` gives them."""
    words = word_ids(path)
    model = AttentionLm(counts, words.starts, words.end)
    learn = documents.where("learn").select("doc_id", "ids", F.xxhash64("doc_id", "ids", F.lit(3)).alias("h"))
    # hashes alone are ordered, so that tasks do not send ids that the driver then drops
    chosen = learn.select("h").orderBy("h").limit(warm_documents).distinct()
    rows = learn.join(F.broadcast(chosen), "h").select("h", "ids").collect()
    first = [ids for _, ids in sorted((r["h"], bytes(r["ids"])) for r in rows)]
    if not first:
        return model
    ids, bounds = _documents(pa.array(first, pa.binary()), words.dtype)
    learner = Learner(model, 0.02)
    for _ in range(WARM_ROUNDS):
        learner.run(ids, bounds)
    sent = documents.sparkSession.sparkContext.broadcast((counts, model.pack()))
    buckets = max(1, -(-int(counts.sum()) // bucket_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        own = without_words(path)
        start_counts, start = sent.value
        total, seen, bucket, held = np.zeros(len(start)), 0, None, []
        learner = None

        def learn_held() -> None:
            """Steps over what is held of the bucket: whole documents, a step's windows spread over them."""
            if held:
                learner.run(*_documents(pa.array(held, pa.binary()), own.dtype))
                held.clear()

        def close() -> None:
            nonlocal total, seen
            if learner is not None:
                learn_held()
                total += learner.model.pack().astype(np.float64) * learner.seen
                seen += learner.seen

        size = 0
        for batch in slices(batches, column="ids"):
            for b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != bucket:
                    close()
                    bucket, size = b, 0
                    model = AttentionLm(start_counts, own.starts, own.end)
                    model.unpack(start)
                    learner = Learner(model, 0.004)
                held.append(packed)
                size += len(packed)
                if size >= 1 << 18:
                    learn_held()
                    size = 0
        close()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([float(seen)])], names=["weights", "seen"])

    dealt = learn.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket", "h", "doc_id", "ids").select("bucket", "ids")
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = None, 0.0
        for batch in batches:
            for w in batch.column(0):
                w = w.values.to_numpy()
                total = w if total is None else total + w
            seen += pc.sum(batch.column(1)).as_py() or 0.0
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([seen])], names=["weights", "seen"])

    tasks = cut(dealt.mapInArrow(run, "weights array<double>, seen double"), "weights")
    sums = tasks.mapInArrow(added, "weights array<double>, seen double").select("seen", F.posexplode("weights").alias("i", "w")).groupBy("i").agg((F.sum("w") / F.sum("seen")).alias("w")).toPandas()
    if len(sums):
        model.unpack(sums.sort_values("i")["w"].to_numpy())
    return model


def _firsts(document: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a hash comes for the first time in its document."""
    order = np.lexsort((h, document))
    d, x = document[order], h[order]
    out = np.ones(len(h), bool)
    out[order[1:]] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return out


def _remembered(scored: DataFrame) -> DataFrame:
    """(row, gain): what the memory of training documents adds to the natural log probability of a document."""
    all_ = scored.where(F.size("stretches") > 0).select("row", F.col("learn").cast("int").alias("own"), F.explode("stretches").alias("w")).select("row", "own", "w.before", "w.whole", "w.p", "w.new_before", "w.new_whole")
    # a document counts once, by the first of its stretches that are alike
    seen = cut(all_.where("own = 1").groupBy("before", "whole").agg(F.count_if("new_whole").alias("m"), F.count_if("new_before").alias("b")), "stretches")
    contexts = cut(seen.groupBy("before").agg(F.sum("b").alias("n")), "contexts")
    # only where other documents have the context
    met = all_.join(contexts, "before").where(F.col("n") > F.col("own"))
    met = met.join(seen.select("whole", "m"), "whole", "left")
    n, m = F.col("n") - F.col("own"), F.coalesce(F.col("m") - F.col("own"), F.lit(0))
    gain = F.log((m + F.exp("p")) / (n + 1)) - F.col("p")
    return met.groupBy("row").agg(F.sum(gain).alias("gain"))


def scores(documents: DataFrame, path: str, **options: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and attention_score of every document."""
    spark = documents.sparkSession
    tokens = cut(encoded(documents, path), "tokens")
    id_rows = tokens.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # one row for each id of the vocabulary
    n_docs = int(id_rows.loc[id_rows["id"] == -1, "n"].sum())
    ids = id_rows[id_rows["id"] >= 0]
    size = word_ids(path).size
    counts = np.bincount(ids["id"].to_numpy(), ids["n"].to_numpy(), size) if len(ids) else np.zeros(size)
    words = cut(tokens.where("h is not null").groupBy("h").agg(F.sum("n").alias("n")), "words")
    # how many words are at least so frequent, by powers of two: the least power that few enough reach is the bound
    of_count = lambda column: F.coalesce(F.sum(column), F.lit(0))
    powers = [of_count(F.when(F.col("n") >= 1 << j, F.col("k"))).alias(f"p{j}") for j in range(48)]
    found = words.groupBy("n").agg(F.count("*").alias("k")).agg(of_count(F.col("n") * F.col("k")).alias("words"), of_count("k").alias("distinct"), *powers).first()
    n_words, distinct = int(found["words"]), int(found["distinct"])
    least = 1 << next(j for j in range(48) if found[f"p{j}"] <= MOST_SENT)
    total, vocabulary = n_words + n_docs, distinct + (n_docs > 0)
    common = words.where(F.col("n") >= least).toPandas()
    docs = tokens.where("ids is not null").select("doc_id", "learn", "ids")
    model = trained(docs, path, counts, **options)
    divisor = float(total + vocabulary + 1)
    sent = spark.sparkContext.broadcast((counts, model.pack(), common["h"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        own = without_words(path)
        id_counts, weights, hashes, numbers = sent.value
        common_counts = Counts(hashes, numbers)
        lm = AttentionLm(id_counts, own.starts, own.end)
        lm.unpack(weights)
        for batch in slices(batches, 1024, 1 << 20, "ids"):
            ids, bounds = _documents(batch.column(2), own.dtype)
            log_p = lm.log_probs_of(ids, bounds)
            summed = np.concatenate([[0.0], np.cumsum(log_p, dtype=np.float64)])
            # a word runs from its first id to the next one's, or to its document's end
            begins, ends = own.starts[ids], np.zeros(len(ids), bool)
            begins[bounds[1:] - 1] = ends[bounds[1:] - 1] = True
            first = np.flatnonzero(begins)
            per_text = np.diff(np.searchsorted(first, bounds)) - 1
            hashes_of = RunHashes(ids)
            own_words = np.flatnonzero(~ends[first])
            h = hashes_of.of(first[own_words], first[own_words + 1])
            c = common_counts.of(h)
            known, text_bounds = c >= 0, lengths_to_bounds(per_text)
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[text_bounds])
            base = [np.log10((c[a:b][known[a:b]] + 1) / divisor).sum() for a, b in zip(text_bounds.tolist(), text_bounds[1:].tolist())]
            tails = pa.ListArray.from_arrays(pa.array(lengths_to_bounds(sums(~known)), pa.int32()), pa.array(h[~known]))
            # stretches but the first, which has nothing before it
            n = -(-np.diff(bounds) // STRETCH)
            low = np.repeat(bounds[:-1], n)
            at = low + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
            later = np.flatnonzero(at > low)
            at, stop = at[later], np.append(at[1:], len(ids))[later]
            p = summed[stop] - summed[at]
            before, whole = hashes_of.of(at - BEFORE, at), hashes_of.of(at - BEFORE, stop)
            per_document = np.maximum(n - 1, 0)
            document = np.repeat(np.arange(len(n)), n)[later]
            fresh = [pa.array(_firsts(document, h)) for h in (before, whole)]
            entries = pa.StructArray.from_arrays([pa.array(before), pa.array(whole), pa.array(p), *fresh], names=["before", "whole", "p", "new_before", "new_whole"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(per_text + 1), pa.array(sums(known & (c > 0)), pa.int64()), pa.array(base, pa.float64()), pa.array(np.diff(summed[bounds]) / np.log(10)), tails,
                 pa.ListArray.from_arrays(pa.array(lengths_to_bounds(per_document), pa.int32()), entries)],
                names=["doc_id", "learn", "n_tokens", "known", "base", "attention_score", "tail", "stretches"],
            )

    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, learn boolean, n_tokens long, known long, base double, attention_score double, tail array<long>, stretches array<struct<before: long, whole: long, p: double, new_before: boolean, new_whole: boolean>>"
    scored = cut(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = words.where(F.col("n") < least)
    tails = scored.where(F.size("tail") > 0).select("row", F.explode("tail").alias("h")).join(rare, "h", "left")
    tails = tails.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / divisor)).alias("rest"))
    rows = scored.drop("tail", "stretches", "learn").join(tails, "row", "left").join(_remembered(scored), "row", "left")
    zero, end = F.lit(0.0), float(np.log10((n_docs + 1) / divisor))
    return rows.select(
        "doc_id", (crc32_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0)) + int(n_docs > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", zero) + end).alias("base_score"), (F.col("attention_score") + F.coalesce("gain", zero) / float(np.log(10))).alias("score"), "attention_score",
    )
