"""Secret scans: fixed patterns, and a character convolutional network over further candidates.

The patterns find the base spans. Every run of token characters from MIN_RUN on, with or
without a digit, is a candidate; the network reads the whole candidate and the characters
around it, and scores all that no base span touches. It is trained here, by tasks, on all labelled
runs: positives are the values that base spans hold, negatives only runs that are surely harmless
(numbers, dates, hosts and paths, a few words of each text), so that a format the patterns miss is
not learnt as a negative. It is calibrated on all held-out runs; its threshold keeps the wanted
recall on them, at the best precision that allows.

Two passes over the texts: one labels runs for training, one finds and scores."""

import math
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm import logistic
from palisade.llm.common import written

#: The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # leftmost runs, those under 24 dropped
KINDS = ("assign", "access", "hex", "cnn")

MIN_RUN = 6
CONTEXT = 16
WORDS_OF_A_TEXT = 4  # harmless words without a digit, far from base spans, that one text offers for training
RECALL = 0.95
SHARD_RUNS = 4096  # runs that a task fits at a time
SHARD_LEAST = 64  # runs of either label in a shard, where there are as many
EPOCHS, RATE = 12, 0.01  # of the first shard; later ones are read once
LOGIT_STEPS, TOP_LOGIT = 1024, 64
PIECE = 4096

_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_RUN},}}")
_DIGIT = re.compile("[0-9]")
_SPLIT = re.compile(r"[+/_.-]+")
_WORD = re.compile(r"(?:[a-z]+|[A-Z][a-z]*|[A-Z]+)[0-9]{0,3}")
_VOWELS = re.compile("[aeiouyAEIOUY]")


def _matches(text: str) -> list:
    """(start, place of kind, kind, end, start of the value) by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def base_spans(text: str) -> list:
    """(start, place of kind, kind, end) by start, then kind."""
    return [m[:4] for m in _matches(text)]


def candidates(text: str) -> list:
    """(start, end) of maximal runs of token characters, at least MIN_RUN long."""
    return [m.span() for m in _RUN.finditer(text)]


def harmless(text: str, start: int, end: int) -> bool:
    """Whether the run is surely no secret: numbers and words (one case or capitalised, a fifth of
    vowels, at most 20 letters) alone or joined as in dates, hosts and paths. What is quoted or
    stands after a colon or an equals sign is never sure, but for what follows a URL's colon."""
    run = text[start:end]
    before = text[max(0, start - CONTEXT) : start]
    if before[-1:] in ("'", '"', "`") or before.rstrip()[-1:] in (":", "=") and not run.startswith("//"):
        return False
    for part in _SPLIT.split(run):
        if part and not part.isdigit() and not (_WORD.fullmatch(part) and len(part) <= 20 and 5 * len(_VOWELS.findall(part)) >= len(part)):
            return False
    return True


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
FOUND, HARD, EASY = range(3)  # sorts of labelled runs: values of base spans; harmless ones with a digit or beside a base span; other harmless ones
LABELLED = "seen string, lead int, n int, sort int"


def _merged(base: list):
    """Starts and ends of the disjoint stretches that the spans cover."""
    starts, ends = [], []
    for s, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _touches(stretches, s: int, e: int) -> bool:
    i = bisect_right(stretches[1], s)
    return i < len(stretches[0]) and stretches[0][i] < e


def labelled(text: str) -> list:
    """(start, end, sort) of the runs that this text offers for training: all values of base
    spans, all harmless runs with a digit or beside a base span, a few other harmless ones."""
    runs, base = candidates(text), _matches(text)
    spans, values = _merged([(m[0], m[3]) for m in base]), _merged(sorted((m[4], m[3]) for m in base))
    starts, out, seen = [s for s, _ in runs], [], set()
    for s, e in zip(*values, strict=True):
        for i in range(max(0, bisect_right(starts, s) - 1), bisect_left(starts, e)):
            if i not in seen and _touches(values, *runs[i]):
                seen.add(i)
                out.append((*runs[i], FOUND))
    near = {i for s, e in zip(*spans, strict=True) for i in range(max(0, bisect_right(starts, s - CONTEXT) - 1), bisect_left(starts, e + CONTEXT))}
    few = {(2 * j + 1) * len(runs) // (2 * WORDS_OF_A_TEXT) for j in range(WORDS_OF_A_TEXT)} if runs else set()
    for i, (s, e) in enumerate(runs):
        hard = i in near or _DIGIT.search(text, s, e) is not None
        if (hard or i in few) and not _touches(spans, s, e) and harmless(text, s, e):
            out.append((s, e, HARD if hard else EASY))
    return out


def _label(batches):
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_py()
            for s, e, sort in labelled(text):
                lead = min(CONTEXT, s)
                if lead + e - s + CONTEXT <= PIECE:
                    rows.append((text[s - lead : e + CONTEXT], lead, e - s, sort))
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["seen", "lead", "n", "sort"])


# ---- the network: embedding, one convolution, max over positions, logistic output


def codes(seen: str) -> np.ndarray:
    """1-95 for printable ASCII, 96 for line ends, 97 for the rest; 0 pads."""
    raw = np.frombuffer(seen.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where((raw >= 32) & (raw < 127), raw - 31, np.where(raw < 32, 96, 97))


def _pad(cands: list):
    """Codes, flags (inside the candidate) and numbers of windows. cands: (seen, lead, length)."""
    longest = max(CharCNN.WIDTH, max(len(s) for s, _, _ in cands))
    x, inside = np.zeros((len(cands), longest), np.int64), np.zeros((len(cands), longest, 1))
    for i, (s, lead, n) in enumerate(cands):
        x[i, : len(s)] = codes(s)
        inside[i, lead : lead + n] = 1
    return x, inside, np.array([max(1, len(s) - CharCNN.WIDTH + 1) for s, _, _ in cands])


class CharCNN:
    WIDTH, EMBED, FILTERS = 5, 8, 32

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"emb": r.normal(0, 0.3, (98, self.EMBED)), "w": r.normal(0, 0.2, (self.WIDTH * (self.EMBED + 1), self.FILTERS)), "b": np.zeros(self.FILTERS), "v": r.normal(0, 0.2, self.FILTERS), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x, inside, windows):
        e = np.concatenate([self.p["emb"][x], inside], 2)
        n = x.shape[1] - self.WIDTH + 1
        win = np.lib.stride_tricks.sliding_window_view(e, self.WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), n, -1)
        conv = win @ self.p["w"] + self.p["b"]
        conv[np.arange(n)[None] >= windows[:, None]] = -np.inf  # padding has no say
        best = conv.argmax(1)
        top = np.take_along_axis(conv, best[:, None, :], 1)[:, 0]
        return win, best, top, np.maximum(top, 0) @ self.p["v"] + self.p["c"][0]

    def fit(self, cands: list, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7):
        r, n, step = np.random.default_rng(seed), len(cands), 0
        m, s = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        weight = np.where(labels, n / (2 * max(1, labels.sum())), n / (2 * max(1, (~labels).sum())))
        by_length = np.argsort([len(c[0]) for c in cands], kind="stable")
        for _ in range(epochs):
            for part in r.permutation(-(-n // batch)):
                i = by_length[part * batch : (part + 1) * batch]
                x, inside, windows = _pad([cands[j] for j in i])
                win, best, top, z = self._forward(x, inside, windows)
                dz = (1 / (1 + np.exp(-z)) - labels[i]) * weight[i] / len(i)
                hidden = np.maximum(top, 0)
                dtop = dz[:, None] * self.p["v"] * (top > 0)
                at = win[np.arange(len(i))[:, None], best]  # (batch, filters, window values)
                dw = np.einsum("bf,bfk->kf", dtop, at)
                dat = (dtop[..., None] * self.p["w"].T).reshape(len(i), self.FILTERS, self.WIDTH, self.EMBED + 1)[..., : self.EMBED]
                demb = np.zeros_like(self.p["emb"])
                where = best[..., None] + np.arange(self.WIDTH)
                np.add.at(demb, x[np.arange(len(i))[:, None, None], where], dat)
                grads = {"emb": demb, "w": dw, "b": dtop.sum(0), "v": hidden.T @ dz, "c": np.array([dz.sum()])}
                step += 1
                for k, g in grads.items():
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def logits(self, cands: list, cells: int = 90_000) -> np.ndarray:
        """Uncalibrated; candidates of like length are padded together, very long ones go in
        overlapping pieces whose maxima are combined."""
        out = np.zeros(len(cands))
        order = sorted(range(len(cands)), key=lambda i: len(cands[i][0]))
        at = 0
        while at < len(order) and len(cands[order[at]][0]) <= PIECE:
            end = at + 1
            while end < len(order) and len(cands[order[end]][0]) <= PIECE and (end - at + 1) * max(self.WIDTH, len(cands[order[end]][0])) <= cells:
                end += 1
            out[order[at:end]] = self._forward(*_pad([cands[i] for i in order[at:end]]))[3]
            at = end
        for i in order[at:]:
            out[i] = self._long(*cands[i])
        return out

    def _long(self, seen: str, lead: int, n: int) -> float:
        top = np.full(self.FILTERS, -np.inf)
        for s in range(0, len(seen) - self.WIDTH + 1, PIECE - self.WIDTH + 1):
            x, inside, windows = _pad([(seen[s : s + PIECE], 0, 0)])
            inside[0, max(0, lead - s) : max(0, lead + n - s)] = 1
            top = np.maximum(top, self._forward(x, inside, windows)[2][0])
        return float(np.maximum(top, 0) @ self.p["v"] + self.p["c"][0])

    def chance(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits * self.scale + self.shift, -60, 60)))

    def score(self, cands: list) -> np.ndarray:
        return self.chance(self.logits(cands))

    def calibrate(self, cands: list, labels: np.ndarray, recall: float):
        return self.calibrated(self.logits(cands), labels, np.ones(len(cands)), recall)

    def calibrated(self, logits: np.ndarray, labels: np.ndarray, weight: np.ndarray, recall: float):
        """Platt scaling, then the threshold: recall kept, precision as high as that allows.
        weight: runs of each logit."""
        self.scale, self.shift = logistic.platt(logits, labels, weight=weight)
        scores = self.chance(logits)
        order = np.argsort(scores[labels], kind="stable")
        own, upto = scores[labels][order], np.cumsum(weight[labels][order])
        high = own[min(len(own) - 1, int(np.searchsorted(upto, math.floor(upto[-1] * (1 - recall)), "right")))]
        # every threshold down to the next negative is as precise: the middle leaves room on both sides
        low = scores[~labels & (scores < high)].max(initial=0.0)
        self.threshold = float((low + high) / 2)
        passed = scores >= self.threshold
        self.recall, self.passed = (float(weight[passed & x].sum() / weight[x].sum()) for x in (labels, ~labels))
        return self


_CODES = np.append(codes("".join(map(chr, range(128)))), 97).astype(np.uint8)
_TOKEN = np.zeros(98, bool)
_TOKEN[codes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")] = True


class Scorer:
    """The network over whole texts: scores every candidate of a group of texts.

    A convolution is linear in the characters and the inside flags, so its values for flag 0 are
    summed from tables of character pairs once a position, and each candidate adds the flags' share
    to the maxima over its windows. Gives what CharCNN.logits gives, up to rounding."""

    GROUP, CHUNK = 500_000, 6_144  # characters; larger ones leave the processor cache

    def __init__(self, net: CharCNN):
        w = net.p["w"].reshape(net.WIDTH, net.EMBED + 1, net.FILTERS)
        one = net.p["emb"] @ w[:, : net.EMBED]  # (width, 98, filters)
        one[:, 0] = -np.inf  # code 0 parts the texts: no window reaches over it
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, net.FILTERS).astype(np.float32)
        self.t01, self.t23, self.t4 = pair(one[0], one[1]), pair(one[2], one[3]), (one[4] + net.p["b"]).astype(np.float32)
        flag = w[:, net.EMBED].astype(np.float32)
        self.after = [flag[j:].sum(0) for j in range(net.WIDTH)]  # windows whose first j characters stand before the candidate
        self.upto = [flag[:j].sum(0) for j in range(net.WIDTH + 1)]  # windows whose first j characters stand in it
        self.net = net

    def add(self, texts: list, spans: list) -> list:
        """spans (dicts, a list for each text) with those of the network."""
        out, at = [], 0
        while at < len(texts):
            end, chars = at + 1, len(texts[at])
            while end < len(texts) and chars + len(texts[end]) <= self.GROUP:
                chars += len(texts[end])
                end += 1
            out += self._group(texts[at:end], spans[at:end])
            at = end
        return out

    def _group(self, texts: list, spans: list) -> list:
        gap = "\0" * CONTEXT
        x = _CODES[np.minimum(np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le"), "<u4"), 128)]
        firsts = CONTEXT + np.cumsum([0, *[len(t) + CONTEXT for t in texts]])
        for f in firsts:
            x[f - CONTEXT : f] = 0
        edge = np.flatnonzero(np.diff(_TOKEN[x]))  # filler at both ends
        starts, ends = edge[::2] + 1, edge[1::2] + 1
        long = ends - starts >= MIN_RUN
        starts, ends = starts[long], ends[long]
        covered = [_merged([(s["start"], s["end"]) for s in row]) for row in spans]
        lo, hi = (np.array([f + v for f, c in zip(firsts, covered, strict=False) for v in c[k]], np.int64) for k in range(2))
        i = np.searchsorted(hi, starts, "right")
        free = np.append(lo, len(x))[i] >= ends
        starts, ends = starts[free], ends[free]
        said = self.net.chance(self.logits(x, starts, ends)) >= self.net.threshold
        out = [list(row) for row in spans]
        for s, e in zip(starts[said].tolist(), ends[said].tolist(), strict=True):
            j = bisect_right(firsts, s) - 1
            out[j].append({"start": s - int(firsts[j]), "kind": 3, "end": e - int(firsts[j])})
        return out

    def logits(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """x: codes, with CONTEXT zeros before, between and after the texts."""
        out = np.zeros(len(starts))
        at = 0
        while at < len(starts):
            if ends[at] - starts[at] > PIECE:
                out[at] = self._top(self._long(x, int(starts[at]), int(ends[at])))
                at += 1
                continue
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + self.CHUNK)))
            over = np.flatnonzero(ends[at:end] - starts[at:end] > PIECE)
            end = at + int(over[0]) if len(over) else end
            base = starts[at] - CONTEXT
            out[at:end] = self._top(self._best(x[base : ends[end - 1] + CONTEXT], starts[at:end] - base, ends[at:end] - base))
            at = end
        return out

    def _top(self, best: np.ndarray) -> np.ndarray:
        return (np.maximum(best, 0) * self.net.p["v"]).sum(-1) + self.net.p["c"][0]

    def _windows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        n = len(x) - 4
        pairs = x[:-1] * 98 + x[1:]
        out = np.take(self.t01, pairs[:n], axis=0, mode="clip")
        out += np.take(self.t23, pairs[2 : n + 2], axis=0, mode="clip")
        out += np.take(self.t4, x[4:], axis=0, mode="clip")
        return out

    def _best(self, x, starts, ends) -> np.ndarray:
        """Maxima over the windows of each candidate; x reaches CONTEXT around them."""
        w = self._windows(x)
        w = np.concatenate([w, np.full((8, w.shape[1]), -np.inf, np.float32)])
        two = np.maximum(w[:-1], w[1:])
        four = np.maximum(two[:-2], two[2:])
        eight = np.maximum(four[:-4], four[4:])
        take = lambda a, i: np.take(a, i, axis=0, mode="clip")
        # inside: two stretches of 2, 4 or 8 windows that overlap, more windows one by one
        n, all_in = ends - starts - 4, self.upto[5]
        best = np.empty((len(starts), w.shape[1]), np.float32)
        for a, size, most in ((two, 2, 4), (four, 4, 8), (eight, 8, 16)):
            i = np.flatnonzero((n >= size) & (n < most))
            best[i] = np.maximum(take(a, starts[i]), take(a, ends[i] - 4 - size))
        if len(i := np.flatnonzero(n >= 16)):
            best[i] = np.maximum.reduceat(w, np.stack([starts[i], ends[i] - 4], 1).ravel(), axis=0)[::2]
        best += all_in
        for j in range(1, 5):
            np.maximum(best, take(w, starts - j) + self.after[j], out=best)
            np.maximum(best, take(w, ends - j) + self.upto[j], out=best)
        for at in (starts - 16, starts - 12, ends, ends + 4):  # 12 windows on each side
            np.maximum(best, take(eight, at), out=best)
        return best

    def _long(self, x, start: int, end: int) -> np.ndarray:
        """The same for one candidate of any length, in pieces."""
        best = np.full(self.net.FILTERS, -np.inf, np.float32)
        share = np.stack([0 * self.upto[5], *self.after[1:], self.upto[5], *self.upto[1:5]])
        for a in range(start - CONTEXT, end + CONTEXT - 4, PIECE):
            z = min(a + PIECE, end + CONTEXT - 4)
            p = np.arange(a, z)
            kind = np.select([p < start - 4, p < start, p < end - 4, p < end], [0, start - p, 5, 5 + end - p], 0)
            best = np.maximum(best, (self._windows(x[a : z + 4]) + share[kind]).max(0))
        return best


def _fit_shard(params: dict, epochs: int, rate: float):
    """Weights after a shard's runs, from the given ones on."""

    def run(table):
        columns = table.select(["_h", "seen", "lead", "n", "found"]).to_pydict().values()
        rows = sorted(zip(*columns, strict=True))
        labels = np.array([r[4] for r in rows], bool)
        # the rarer label is repeated up to a quarter of the runs, so that steps are not few heavy ones
        some = [np.flatnonzero(labels == x) for x in (True, False)]
        most = max(map(len, some))
        order = np.concatenate([np.tile(x, max(1, most // (3 * len(x)))) for x in some if len(x)])
        net = CharCNN()
        net.p = {k: v.copy() for k, v in params.items()}
        net.fit([rows[i][1:4] for i in order], labels[order], epochs=epochs, rate=rate)
        return pa.table({"params": pa.array([np.concatenate([net.p[k].ravel() for k in sorted(net.p)])], pa.list_(pa.float64()))})

    return run


def _round(shards: DataFrame, net: CharCNN, first: int, last: int, epochs: int, rate: float) -> None:
    """Fit shards first to last at once and take the mean of their weights. Decimals add up to the
    same sum in any order."""
    mine = shards.where(F.col("_shard").between(first, last)).repartition(last - first + 1, "_shard")
    fitted = mine.groupBy("_shard").applyInArrow(_fit_shard(net.p, epochs, rate), "params array<double>")
    sums = fitted.select(F.posexplode("params").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(28,15)")).alias("s"), F.count("*").alias("n")).collect()
    if not sums:
        return
    flat, at = np.zeros(len(sums)), 0
    for r in sums:
        flat[r["i"]] = float(r["s"]) / r["n"]
    for k in sorted(net.p):
        size = net.p[k].size
        net.p[k], at = flat[at : at + size].reshape(net.p[k].shape), at + size


def _logits(net: CharCNN):
    def run(batches):
        for batch in batches:
            cands = list(zip(*(batch.column(c).to_pylist() for c in ("seen", "lead", "n")), strict=True))
            z = np.rint(np.clip(net.logits(cands), -TOP_LOGIT, TOP_LOGIT) * LOGIT_STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("found"), pa.array(z)], ["found", "z"])

    return run


def train(runs: DataFrame, recall: float = RECALL, least: int = 8, shard_runs: int = SHARD_RUNS):
    """A network from all distinct labelled runs; None with fewer than `least` of either label.
    runs: seen, lead, n, sort.

    A quarter of them, by the hash of what is seen, is held out: calibration and threshold follow
    from the counts of all their logits, in steps of 1 / LOGIT_STEPS. The others are dealt out by
    hash to shards of about shard_runs. The first shard is fitted alone, then 2, 4, 8 and so on at
    once from the weights so far, whose mean goes on: each run is fitted in one round, and a table
    of any size takes a logarithmic number of rounds. Where a label is rare, its runs go to several
    shards."""
    key = F.xxhash64("seen", "lead", "n")
    found = F.col("sort") == FOUND
    all_ = written(runs.groupBy("seen", "lead", "n").agg(F.max(found).alias("found")).withColumn("_h", key), "secret-runs")
    held = [F.pmod(F.xxhash64("_h", F.lit(salt)), F.lit(4)) == 0 for salt in range(16)]
    counts = {r["found"]: r for r in all_.groupBy("found").agg(F.count("*").alias("n"), *[F.count_if(h).alias(f"h{i}") for i, h in enumerate(held)]).collect()}
    if any(x not in counts or counts[x]["n"] < least for x in (True, False)):
        return None
    # the first hash that leaves runs of both labels on both sides
    side = next((i for i in range(16) if all(0 < c[f"h{i}"] < c["n"] for c in counts.values())), 0)
    n_fit = {x: c["n"] - c[f"h{side}"] for x, c in counts.items()}
    n_shards = max(1, -(-sum(n_fit.values()) // shard_runs))
    copies = {x: min(n_shards, -(-SHARD_LEAST * n_shards // max(1, n))) for x, n in n_fit.items()}
    more = F.explode(F.sequence(F.lit(0), F.when(F.col("found"), copies[True] - 1).otherwise(copies[False] - 1)))
    shards = all_.where(~held[side]).select("*", more.alias("_copy")).withColumn("_shard", F.pmod(F.pmod(F.col("_h"), F.lit(n_shards)) + F.col("_copy"), F.lit(n_shards)))
    net, first, number = CharCNN(), 0, 0
    while first < n_shards:
        last = min(n_shards, 2 * first + 1) - 1
        _round(shards, net, first, last, EPOCHS if number == 0 else 1, RATE / 2 ** (number / 2))
        first, number = last + 1, number + 1
    hist = all_.where(held[side]).select("found", "seen", "lead", "n").mapInArrow(_logits(net), "found boolean, z long").groupBy("found", "z").count().collect()
    hist = sorted((r["z"], r["found"], r["count"]) for r in hist)
    z, labels, weight = (np.array(c) for c in zip(*hist, strict=True))
    return net.calibrated(z / LOGIT_STEPS, labels.astype(bool), weight.astype(float), recall)


def _scan(net):
    def run(batches):
        scorer = Scorer(net) if net is not None else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [[{"start": s, "kind": k, "end": e} for s, k, _, e in base_spans(t)] for t in texts]
            if scorer is not None:
                spans = [sorted(s, key=lambda x: (x["start"], x["kind"])) for s in scorer.add(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    return run


def network(docs: DataFrame, text: str = "text", recall: float = RECALL):
    """The network for the texts of docs; its `recall` and `passed` are the shares of held-out
    findings and harmless runs that reach the threshold. None where too few runs are labelled."""
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return train(written(texts.mapInArrow(_label, LABELLED), "secret-labels"), recall)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, spans (array of start, kind, end in code points, end exclusive) of every row.

    kind counts KINDS from 0; spans stand by start, then kind. Base spans always stay; spans of
    the network cover candidates that no base span touches. Null texts count as empty; repeated
    rows are scanned each; tables with too few labelled findings get base spans alone."""
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(_scan(network(docs, text, recall)), "doc_id long, spans array<struct<start:long,kind:int,end:long>>")


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
