"""A bidirectional gated recurrent network with attention pooling over words and their characters, in numpy."""

from __future__ import annotations

import re
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_LOOK = str.maketrans(LOOKALIKES)
_LEET = str.maketrans(LEET)
_NAME = re.compile(r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b")
_SPACED = re.compile(r"(?<![\w])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![\w])")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[^\W_]+(?:[*@$'’][\w*@$]*)*|[.!?:;\"«»„“”,()\n]")
_NUMBER = re.compile(r"[\d.,]+$")
#: A single letter at the end or start of a run, and two of them with a sign between.
_LAST, _FIRST = re.compile(r"(?:^|[\W_])[^\W\d_]$"), re.compile(r"[^\W\d_](?:$|[\W_])")
_LAST_TWO, _FIRST_TWO = re.compile(r"[^\W\d_][ .\-_*][^\W\d_]$"), re.compile(r"[^\W\d_][ .\-_*][^\W\d_](?:$|[\W_])")


def _folded(text: str) -> str:
    """Names as one class, other scripts' lookalikes and accents led back to plain lower-case letters."""
    text = _NAME.sub(" xname ", text)
    text = unicodedata.normalize("NFKC", text).lower().translate(_LOOK)
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) not in ("Mn", "Cf"))


def words(text: str) -> list[str]:
    """Tokens for the network: names and numbers as classes, disguised spellings led back to letters."""
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), _folded(text))
    text = _LONG.sub(r"\1", text)
    out = []
    for w in _WORD.findall(text):
        if _NUMBER.match(w):
            out.append("0" if w[0].isdigit() else w)
        elif any(c.isalpha() for c in w) and any(c in LEET for c in w):
            out.append(w.translate(_LEET))
        else:
            out.append(w)
    return out


def windows(n: int, width: int, stride: int) -> list[tuple[int, int]]:
    """Spans that cover all n tokens, each overlapping the one before by ``width - stride``."""
    return [(i, min(n, i + width)) for i in range(0, max(1, n - (width - stride)), stride)] if n else []


def all_windows(size: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, length, text) of the windows of texts with ``size`` tokens each that lie one behind the other."""
    count = np.where(size > 0, -(-np.maximum(1, size - (width - stride)) // stride), 0)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(np.cumsum(size) - size, count) + nth * stride
    return first, np.minimum(width, size[owner] - nth * stride), owner


class Words:
    """Word and character-n-gram bucket ids of each distinct word, and the words of each distinct run of non-blanks, kept while a task runs."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.at: dict[str, int] = {}
        self.word: list[int] = []
        self.grams: list[list[int]] = []
        self.runs: dict[str, tuple[list[int], int]] = {"": ([], 0)}

    def ids(self, tokens: list[str]) -> list[int]:
        out = []
        for w in tokens:
            i = self.at.get(w)
            if i is None:
                i = self.at[w] = len(self.word)
                self.word.append(zlib.crc32(w.encode()) % self.buckets)
                s = f"<{w}>"
                self.grams.append([zlib.crc32(s[k : k + n].encode(), n) % self.buckets for n in (2, 3, 4) for k in range(len(s) - n + 1)] or [0])
            out.append(i)
        return out

    def _run(self, text: str) -> tuple[list[int], int]:
        """Ids of a run without blanks, and as bits how its ends could belong to letters that are spaced out over several runs."""
        f = _folded(text)
        ends, starts = _LAST.search(f), _FIRST.match(f)
        bits = bool(ends) | bool(starts) << 1 | (len(f) == 1 and bool(ends)) << 2 | bool(_LAST_TWO.search(f)) << 3 | bool(_FIRST_TWO.match(f)) << 4
        got = self.runs[text] = (self.ids(words(text)), bits)
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, number of ids of each text): what ``ids(words(text))`` gives for each; NULL has none.

        Texts fall into runs at blanks and line ends, and each distinct run is looked at once. Only letters spaced out over
        several runs are not to be seen in one; texts that may hold such go through ``words`` as a whole.
        """
        if len(self.runs) > 500_000:
            self.runs = {"": ([], 0)}
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        known = [self.runs.get(r) or self._run(r) for r in coded.dictionary.to_pylist()]
        at = coded.indices.to_numpy(zero_copy_only=False)
        length = np.fromiter((len(k[0]) for k in known), np.int64, len(known))
        pool = np.fromiter(chain.from_iterable(k[0] for k in known), np.int32, int(length.sum()))
        start = np.cumsum(length) - length
        each = length[at]
        before = np.cumsum(each) - each
        flat = pool[np.repeat(start[at] - before, each) + np.arange(int(each.sum()))]
        ends = np.r_[before, each.sum()][offsets]
        bits = np.fromiter((k[1] for k in known), np.uint8, len(known))[at]
        pad = np.r_[np.uint8(0), bits, np.uint8(0), np.uint8(0)]
        last, here, nxt, after = pad[:-3], pad[1:-2], pad[2:-1], pad[3:]
        meets = (here & 1 > 0) & (nxt & 2 > 0)
        spaced = meets & ((here & 8 > 0) | (nxt & 16 > 0) | ((nxt & 4 > 0) & (after & 2 > 0)) | ((here & 4 > 0) & (last & 1 > 0)))
        size = np.diff(ends)
        whole = np.unique(np.searchsorted(offsets, np.flatnonzero(spaced), "right") - 1) if spaced.any() else []
        if len(whole):
            parts, done = [], 0
            for i in whole:
                own = self.ids(words(texts[int(i)].as_py()))
                parts += [flat[ends[done] : ends[i]], np.array(own, np.int32)]
                size[i], done = len(own), i + 1
            flat = np.concatenate([*parts, flat[ends[done] :]])
        return flat, size


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and passes. Inputs are tables over distinct words, so a word is embedded and projected once a batch."""

    def __init__(self, buckets: int = 8192, dim: int = 16, hidden: int = 24, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.buckets, self.dim, self.hidden = buckets, dim, hidden
        self.p = {"word": (r.standard_normal((buckets, dim)) * 0.3).astype(np.float32), "gram": (r.standard_normal((buckets, dim)) * 0.5).astype(np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": f(2 * dim, 3 * hidden), f"u{d}": f(hidden, 3 * hidden), f"a{d}": np.zeros(3 * hidden, np.float32), f"c{d}": np.zeros(3 * hidden, np.float32)}
        self.p |= {"wa": f(2 * hidden, hidden), "ba": np.zeros(hidden, np.float32), "va": f(hidden, 1)[:, 0], "wo": f(2 * hidden, 1)[:, 0], "bo": np.full(1, -2, np.float32)}

    def table(self, vocab: Words, use: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Input vectors of the words ``use``."""
        wid = np.array([vocab.word[i] for i in use])
        lists = [vocab.grams[i] for i in use]
        size = np.array([len(x) for x in lists])
        flat = np.concatenate(lists).astype(np.int64)
        start = np.r_[0, np.cumsum(size)[:-1]]
        chars = np.add.reduceat(self.p["gram"][flat], start, axis=0) / np.sqrt(size)[:, None]
        return np.concatenate([self.p["word"][wid], chars.astype(np.float32)], 1), (wid, flat, size)

    def _run(self, proj: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """``proj``: steps x batch x gates, already in this direction's order."""
        t, b, _ = proj.shape
        k = self.hidden
        h = np.zeros((b, k), np.float32)
        out = np.empty((t, b, k), np.float32)
        u, c = self.p[f"u{d}"], self.p[f"c{d}"]
        kept = []
        for i in range(t):
            hu = h @ u + c
            zr = _sig(proj[i, :, : 2 * k] + hu[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(proj[i, :, 2 * k :] + r * hu[:, 2 * k :])
            new = n + z * (h - n)
            m = mask[i][:, None]
            if keep:
                kept.append((h, z, r, n, hu[:, 2 * k :], m))
            h = h + m * (new - h)
            out[i] = h
        return out, kept

    def forward(self, table: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logit of each window. ``idx``: batch x steps into ``table``; ``mask``: 1 on tokens."""
        it, mt = idx.T, mask.T.astype(np.float32)
        hs, kept = [], []
        for d in "fb":
            proj = (table @ self.p[f"w{d}"] + self.p[f"a{d}"])[it if d == "f" else it[::-1]]
            out, k = self._run(proj, mt if d == "f" else mt[::-1], d, keep)
            hs.append(out if d == "f" else out[::-1])
            kept.append(k)
        h = np.concatenate(hs, 2)
        a = np.tanh(h @ self.p["wa"] + self.p["ba"])
        e = a @ self.p["va"] + (mt - 1) * 1e4
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        ctx = (alpha[:, :, None] * h).sum(0)
        return ctx @ self.p["wo"] + self.p["bo"][0], (h, a, alpha, ctx, kept, it, mt)

    def backward(self, table: np.ndarray, parts: tuple, state: tuple, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        h, a, alpha, ctx, kept, it, _ = state
        k, g = self.hidden, {}
        g["wo"], g["bo"] = ctx.T @ dlogit, dlogit.sum(keepdims=True)
        dctx = dlogit[:, None] * self.p["wo"]
        dalpha = (h * dctx).sum(2)
        dh = alpha[:, :, None] * dctx
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        g["va"] = np.tensordot(de, a, ([0, 1], [0, 1]))
        da = de[:, :, None] * self.p["va"] * (1 - a * a)
        g["wa"], g["ba"] = h.reshape(-1, 2 * k).T @ da.reshape(-1, k), da.sum((0, 1))
        dh += da @ self.p["wa"].T
        dtable = np.zeros_like(table)
        flat = it.reshape(-1)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
        for j, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            dout = dh[:, :, j * k : (j + 1) * k]
            dout = dout if d == "f" else dout[::-1]
            dproj = np.empty((len(kept[j]), dout.shape[1], 3 * k), np.float32)
            du, dc, back = np.zeros_like(u), np.zeros(3 * k, np.float32), np.zeros_like(dout[0])
            for i in range(len(kept[j]) - 1, -1, -1):
                hp, z, r, n, hun, m = kept[j][i]
                total = dout[i] + back
                dnew = total * m
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (hp - n) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                dproj[i] = np.concatenate([dz, dr, dn], 1)
                dhu = np.concatenate([dz, dr, dn * r], 1)
                du += hp.T @ dhu
                dc += dhu.sum(0)
                back = total * (1 - m) + dnew * z + dhu @ u.T
            g[f"u{d}"], g[f"c{d}"] = du, dc
            dproj = (dproj if d == "f" else dproj[::-1]).reshape(-1, 3 * k)
            per_word = np.zeros((len(table), 3 * k), np.float32)
            per_word[flat[order][first]] = np.add.reduceat(dproj[order], first, axis=0)
            g[f"w{d}"], g[f"a{d}"] = table.T @ per_word, per_word.sum(0)
            dtable += per_word @ self.p[f"w{d}"].T
        wid, grams, size = parts
        added = lambda at, rows: np.stack([np.bincount(at, c, self.buckets) for c in rows.T], 1).astype(np.float32)
        g["word"] = added(wid, dtable[:, : self.dim])
        g["gram"] = added(grams, np.repeat(dtable[:, self.dim :] / np.sqrt(size)[:, None], size, axis=0))
        return g

    def dump(self) -> bytes:
        import io

        f = io.BytesIO()
        np.savez(f, shape=np.array([self.buckets, self.dim, self.hidden]), **self.p)
        return f.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Network:
        import io

        z = np.load(io.BytesIO(raw))
        net = cls.__new__(cls)
        net.buckets, net.dim, net.hidden = (int(x) for x in z["shape"])
        net.p = {k: z[k] for k in z.files if k != "shape"}
        return net


class Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, g: dict[str, np.ndarray], decay: float) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            x = x * scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.net.p[k] -= self.rate * (fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8) + (decay * self.net.p[k] if k not in ("bo", "ba") else 0))


def _batch(net: Network, vocab: Words, spans: list[list[int]]) -> tuple[np.ndarray, tuple, np.ndarray, np.ndarray]:
    width = max(map(len, spans))
    idx = np.zeros((len(spans), width), np.int64)
    mask = np.zeros((len(spans), width), np.float32)
    for i, s in enumerate(spans):
        idx[i, : len(s)] = s
        mask[i, : len(s)] = 1
    idx[mask == 0] = spans[0][0]
    use, inverse = np.unique(idx, return_inverse=True)
    table, parts = net.table(vocab, use)
    return table, parts, inverse.reshape(idx.shape), mask


class Scorer:
    """Forward passes only, over windows of one length at a time, so that nothing is masked.

    Each word is projected once for both directions, and the halves that turn ``tanh`` into the gates' sigmoid are part of the weights.
    All arrays are whole blocks of windows x units, one for each gate, which keeps the elementwise work in the cache.
    """

    def __init__(self, net: Network, vocab: Words):
        self.net, self.vocab, k = net, vocab, net.hidden
        self.known = 0
        self.rows = np.zeros((2, 3, 0, k), np.float32)
        half = np.array([0.5, 0.5, 0.5], np.float32)[:, None, None]
        gates = lambda a: a.reshape(-1, 3, k).transpose(1, 0, 2)
        self.u = np.stack([np.ascontiguousarray(gates(net.p[f"u{d}"]) * half) for d in "fb"])
        self.late = np.stack([net.p[f"c{d}"][2 * k :] * np.float32(0.5) for d in "fb"])[:, None, :]
        self.wa = np.stack([net.p["wa"][:k], net.p["wa"][k:]])

    def _project(self) -> None:
        """Adds the words that are new to the vocabulary."""
        n, k, p = len(self.vocab.word), self.net.hidden, self.net.p
        if n == self.known:
            return
        if n > self.rows.shape[2]:
            grown = np.zeros((2, 3, max(1024, 2 * n), k), np.float32)
            grown[:, :, : self.known] = self.rows[:, :, : self.known]
            self.rows = grown
        table, _ = self.net.table(self.vocab, np.arange(self.known, n))
        for j, d in enumerate("fb"):
            full = table @ p[f"w{d}"] + p[f"a{d}"]
            full[:, : 2 * k] = (full[:, : 2 * k] + p[f"c{d}"][: 2 * k]) * 0.5
            self.rows[j, :, self.known : n] = full.reshape(-1, 3, k).transpose(1, 0, 2)
        self.known = n

    def _scores(self, idx: np.ndarray) -> np.ndarray:
        """``idx``: steps x windows."""
        t, b = idx.shape
        k, p = self.net.hidden, self.net.p
        h = np.zeros((2, b, k), np.float32)
        hx, x, u = np.empty((2, 3, b, k), np.float32), np.empty((2, 3, b, k), np.float32), np.empty((2, b, k), np.float32)
        zr, z, r, n, xzr, xn = hx[:, :2], hx[:, 0], hx[:, 1], hx[:, 2], x[:, :2], x[:, 2]
        late = np.ascontiguousarray(np.broadcast_to(self.late, (2, b, k)))
        one, half = np.float32(1), np.float32(0.5)
        out = np.empty((2, t, b, k), np.float32)
        for i in range(t):
            np.take(self.rows[0], idx[i], axis=1, out=x[0], mode="clip")
            np.take(self.rows[1], idx[t - 1 - i], axis=1, out=x[1], mode="clip")
            np.matmul(h[:, None], self.u, out=hx)
            zr += xzr
            np.tanh(zr, out=zr)
            zr += one
            np.add(n, late, out=u)
            u *= r
            u += xn
            np.tanh(u, out=u)
            z *= half
            h -= u
            h *= z
            h += u
            out[0, i], out[1, t - 1 - i] = h[0], h[1]
        flat = out.reshape(2, t * b, k)
        a = flat[0] @ self.wa[0]
        a += flat[1] @ self.wa[1]
        a += p["ba"]
        np.tanh(a, out=a)
        e = (a @ p["va"]).reshape(t, b)
        e = np.exp(e - e.max(0))
        # What the pooled state gives is the pooled sum of what each state gives.
        said = (flat[0] @ p["wo"][:k] + flat[1] @ p["wo"][k:]).reshape(t, b)
        return _sig((e * said).sum(0) / e.sum(0) + p["bo"][0])

    def windows(self, flat: np.ndarray, first: np.ndarray, length: np.ndarray, batch: int = 512) -> np.ndarray:
        """Probability of each window of ``flat``, the ids of all texts."""
        self._project()
        out = np.empty(len(first), np.float32)
        order = np.argsort(length, kind="stable")
        edge = np.flatnonzero(np.diff(length[order])) + 1
        for part in np.split(order, edge):
            if len(part):
                steps = np.arange(length[part[0]])[:, None]
                for at in range(0, len(part), batch):
                    own = part[at : at + batch]
                    out[own] = self._scores(flat[first[own][None, :] + steps])
        return out


def score_windows(net: Network, vocab: Words, spans: list[list[int]], batch: int = 512) -> np.ndarray:
    """Probability of each window."""
    size = np.fromiter(map(len, spans), np.int64, len(spans))
    flat = np.fromiter(chain.from_iterable(spans), np.int64, int(size.sum()))
    return Scorer(net, vocab).windows(flat, np.cumsum(size) - size, size, batch)


def train(texts: list[str], target: np.ndarray, width: int = 40, stride: int = 20, epochs: int = 8, seed: int = 7, batch: int = 256, rate: float = 0.004, positive_weight: float = 2.0, least_steps: int = 600, word_dropout: float = 0.1, decay: float = 1e-4) -> Network:
    """Learns from labels of whole texts, some of which are wrong.

    A flagged text has at least one window with such content, an unflagged one none. In the first two
    epochs all windows carry the label of their text; later a flagged text is represented by its
    highest window, an unflagged one by its highest and two others. From the
    fourth epoch on, a text whose label the network firmly contradicts changes sides.
    Few texts are learnt in smaller batches and more epochs, so that ``least_steps`` steps come about.
    """
    rng = np.random.default_rng(seed)
    net = Network(seed=seed)
    vocab = Words(net.buckets)
    flat, size = vocab.encode(pa.array(texts, pa.large_string()))
    first, length, owner = all_windows(size, width, stride)
    if not len(owner):
        return net
    spans = [flat[a : a + n].tolist() for a, n in zip(first, length)]
    target = target.astype(np.float32)
    count = np.bincount(owner, minlength=len(texts))
    batch = int(np.clip(3 * len(texts) // 60, 16, batch))
    epochs = max(epochs, min(40, least_steps * batch // (3 * len(texts))))
    adam = Adam(net, rate)
    top = np.full(len(texts), -1, dtype=np.int64)
    for epoch in range(epochs):
        wanted = target.copy()
        if epoch >= 2:
            score = Scorer(net, vocab).windows(flat, first, length)
            order = np.lexsort((score, owner))
            last = np.flatnonzero(np.r_[np.diff(owner[order]) > 0, True])
            top[owner[order][last]] = order[last]
            best = np.where(top >= 0, score[np.maximum(top, 0)], 0)
            if epoch >= 3:
                wanted[(target >= 0.5) & (best < 0.2)] = 0
                wanted[(target < 0.5) & (best > 0.9)] = 1
        flagged = wanted[owner] >= 0.5
        if epoch < 2:
            chosen = np.flatnonzero(flagged | (rng.random(len(owner)) < 6 / count[owner]))
            weight = np.where(flagged[chosen], positive_weight / np.sqrt(count[owner[chosen]]), 1.0)
        else:
            tops = top[top >= 0]
            others = np.flatnonzero(~flagged & (rng.random(len(owner)) < 2 / count[owner]))
            chosen = np.unique(np.concatenate([tops, others]))
            weight = np.where(flagged[chosen], positive_weight, 1.0)
        mixed = rng.permutation(len(chosen))
        chosen, weight = chosen[mixed], weight[mixed].astype(np.float32)
        adam.rate = rate * (1 - 0.8 * epoch / max(1, epochs - 1))
        for at in range(0, len(chosen), batch):
            part = chosen[at : at + batch]
            _step(net, adam, vocab, [spans[i] for i in part], wanted[owner[part]], weight[at : at + batch], rng, word_dropout, decay)
    return net


def _step(net: Network, adam: Adam, vocab: Words, spans: list[list[int]], wanted: np.ndarray, weight: np.ndarray, rng: np.random.Generator, word_dropout: float, decay: float) -> None:
    table, parts, idx, mask = _batch(net, vocab, spans)
    keep = (rng.random(len(table)) > word_dropout).astype(np.float32)  # a word is now and then known by its characters alone
    table[:, : net.dim] *= keep[:, None]
    logit, state = net.forward(table, idx, mask, keep=True)
    d = (_sig(logit) - wanted) * weight / len(spans)
    adam.step(net.backward(table, parts, state, d.astype(np.float32)), decay)


def distil(texts: list[str], teachers: list[Network], width: int = 40, stride: int = 20, epochs: int = 4, seed: int = 17, batch: int = 256, rate: float = 0.004, least_steps: int = 600, word_dropout: float = 0.1, decay: float = 1e-5) -> Network:
    """One network that gives what the teachers give on average, window by window, at the cost of one.

    It starts from the first teacher. Each epoch takes the windows on which the teachers say 0.02 or more, or on which they and
    it were apart by 0.02 or more, and as many others, one for each text at least, drawn anew.
    """
    rng = np.random.default_rng(seed)
    net = Network.load(teachers[0].dump())
    vocab = Words(net.buckets)
    flat, size = vocab.encode(pa.array(texts, pa.large_string()))
    first, length, owner = all_windows(size, width, stride)
    if not len(owner):
        return net
    wanted = np.mean([Scorer(t, vocab).windows(flat, first, length) for t in teachers], axis=0)
    spans = [flat[a : a + n].tolist() for a, n in zip(first, length)]
    batch = int(np.clip(3 * len(texts) // 60, 16, batch))
    epochs = max(epochs, min(40, least_steps * batch // (3 * len(texts))))
    adam = Adam(net, rate)
    for epoch in range(epochs):
        apart = np.abs(Scorer(net, vocab).windows(flat, first, length) - wanted) >= 0.02
        told = np.flatnonzero((wanted >= 0.02) | apart)
        rest = np.setdiff1d(np.arange(len(owner)), told)
        chosen = np.concatenate([told, rng.choice(rest, min(len(rest), max(len(told), len(texts))), replace=False)])
        rng.shuffle(chosen)
        adam.rate = rate * (1 - 0.9 * epoch / max(1, epochs - 1))
        for at in range(0, len(chosen), batch):
            part = chosen[at : at + batch]
            _step(net, adam, vocab, [spans[i] for i in part], wanted[part], np.ones(len(part), np.float32), rng, word_dropout, decay)
    return net
