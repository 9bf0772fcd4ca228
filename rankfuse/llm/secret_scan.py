"""Secrets in texts: three rules, and a character network for what the rules don't say.

*Base* spans come from rules, leftmost first and without overlaps within a kind: assignments to
words such as ``password`` or ``token``, access keys, and long hexadecimal numbers. They always stay.
Other *candidates* are runs of ``TOKEN`` characters with a digit or both cases of letters in them
that touch no base span. A convolutional network over characters scores each candidate together
with ``AROUND`` characters on either side; those at or above the threshold of their shape are
added as spans of kind ``model``.

*Network.* ``FILTERS`` filters of ``WIDTH`` characters (a table look-up for each of their places, so
no products) run over the whole candidate and its surroundings; their largest values left of it, in
it and right of it go through a small hidden layer to one probability. A candidate of any length is
read whole, ``BLOCK`` places at a time.

*Labels.* Base findings are the labelled secrets, all other candidates the labelled rest: all of
them, of any length, each different one once, so that copies of a document count once. A secret is shown
three times: as it is, without its surroundings (so that the network learns to know it by itself), and
with its characters redrawn from the rules' own alphabets. One fifth of the values is kept for
calibration (Platt's line over the logits), another one for the report.

*Training* is spread over the tasks. The labelled rows are dealt by hash to parts of some ``PART_ROWS``;
if a part would hold fewer than ``PART_LEAST`` of the rarer label, each row of it goes to several parts. In
each of ``ROUNDS`` rounds every part takes the shared network over all its rows (half of each batch from
either label, the rarer one repeated) and the networks of the parts are averaged, weighted by their rows.
Only networks (some 140 kB a part) reach the driver. The calibration line is fitted by sums over all
calibration rows, the thresholds are exact places in their order (``ordering.select_ranks``).

*Thresholds.* For each shape (``hex``, ``access``: capitals and digits, ``assign``: the rest) the highest
threshold that still finds ``RECALL`` of the calibration secrets of that shape, of all shapes if
there are fewer than ``ENOUGH``. Where that lies above what ``USUAL`` of the other calibration
candidates reach, the place half way down to them is taken (recall only grows), but nothing below
``LEAST``.

*Cross-fitting.* A secret that no rule finds is among the labelled rest, so a network could learn it as
harmless. Values are therefore halved by hash, each half trains its own network, and a candidate is
judged by the network of the other half, which has not seen its value.

Without a base finding or without any other candidate nothing can be learned: base spans only.
Nulls: a null text is empty; a null id is an id like others. Empty texts have no spans; very long
texts and candidates are read whole. Ties: spans with equal starts stand in the order of ``KINDS``.
Repeated rows are rows of their own with equal results, and teach once. Empty tables give empty
results. Extra columns pass through ``findings``, less ``text``; one called ``findings`` is replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import select_ranks
from . import common

KINDS = ("assign", "access", "hex", "model")
#: The rules (fixed values). ASCII letters only change case; matches that are too short are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
AROUND = 24
FILTERS, WIDTH, HIDDEN = 24, 5, 16
CODES = 130  # ASCII, anything else, outside the text
OTHER, OUTSIDE = 128, 129
RECALL, ENOUGH, USUAL, LEAST = 0.98, 50, 0.99, 0.5
ROUNDS, STEPS, BATCH, RATE, SEED = 4, 300, 128, 0.01, 7  # STEPS: of a part, at least
#: Labelled rows of a training part and their characters, about, and how many of each label it has if there are so many.
PART_ROWS, PART_CHARS, PART_LEAST = 16_384, 1 << 25, 256
BLOCK = 1 << 16
SLICE_ROWS = 256

FOUND = "array<struct<kind: string, start: long, end: long, left: string, value: string, right: string>>"
FINDINGS = "array<struct<kind: string, start: long, end: long, value: string, score: double>>"


# --- rules and candidates -------------------------------------------------------------------------

def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """``kind, start, end, start of the value``, by start, then kind."""
    out = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def telling(value: str) -> bool:
    """A digit, or letters of both cases."""
    return any("0" <= c <= "9" for c in value) or (value.lower() != value and value.upper() != value)


def found_in(text: str | None) -> list[tuple[str, int, int, str, str, str]]:
    """Base spans and other candidates (kind ``model``): ``kind, start, end, left, value, right``."""
    if not text:
        return []
    base = base_spans(text)
    out = [(k, a, b, text[max(0, v - AROUND) : v], text[v:b], text[b : b + AROUND]) for k, a, b, v in base]
    reach, ends = 0, []  # how far the base spans up to each one reach
    for _, _, b, _ in base:
        reach = max(reach, b)
        ends.append(reach)
    starts = [a for _, a, _, _ in base]
    for m in TOKEN.finditer(text):
        a, b = m.start(), m.end()
        i = bisect.bisect_left(starts, b)
        if (i and ends[i - 1] > a) or not telling(m.group()):
            continue
        out.append(("model", a, b, text[max(0, a - AROUND) : a], m.group(), text[b : b + AROUND]))
    return out


def shape(value: str) -> str:
    if re.fullmatch(r"[0-9a-fA-F]+", value):
        return "hex"
    return "access" if re.fullmatch(r"[A-Z0-9]+", value) else "assign"


# --- network --------------------------------------------------------------------------------------

def codes_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < 128, raw, OTHER).astype(np.int16)


@dataclass
class Net:
    """``table`` (place, code, filter), ``bias``, hidden layer, output; then Platt's line and thresholds."""

    table: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] | None = None
    report: dict[str, float] | None = None

    @staticmethod
    def fresh() -> Net:
        rng = np.random.default_rng(SEED)
        return Net(rng.normal(0, 0.15, (WIDTH, CODES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, (3 * FILTERS, HIDDEN)),
                   np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1))

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def conv(self, line: np.ndarray, lo: int, up: int) -> np.ndarray:
        """Filter values at the places ``lo .. up`` of a padded line of codes."""
        x = np.broadcast_to(self.bias, (up - lo, FILTERS)).copy()
        for j in range(WIDTH):
            x += self.table[j, line[lo + j : up + j]]
        return x

    def pooled(self, line: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The largest value of each filter between neighbouring ``edges`` (0 at least)."""
        out = np.zeros((len(edges) - 1, FILTERS))
        for lo in range(int(edges[0]), int(edges[-1]), BLOCK):
            up = min(lo + BLOCK, int(edges[-1]))
            first = int(np.searchsorted(edges, lo, "right")) - 1
            last = int(np.searchsorted(edges, up, "left"))
            a, b = np.maximum(edges[first:last], lo), np.minimum(edges[first + 1 : last + 1], up)
            some = np.flatnonzero(b > a)
            best = np.maximum.reduceat(self.conv(line, lo, up), a[some] - lo)
            out[first + some] = np.maximum(out[first + some], best)
        return out

    def logits(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        line, edges = lined(rows)
        p = self.pooled(line, edges).reshape(len(rows), 4, FILTERS)[:, :3].reshape(len(rows), 3 * FILTERS)
        return np.tanh(p @ self.hidden + self.hidden_bias) @ self.out + self.out_bias[0]

    def scores(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(rows) + self.offset, -60, 60)))

    def gradients(self, rows: list[tuple[str, str, str]], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy and its gradient for each of ``weights``."""
        line, edges = lined(rows)
        n = len(rows)
        best, at = np.zeros((4 * n, FILTERS)), np.zeros((4 * n, FILTERS), np.int64)
        every = np.arange(FILTERS)
        for lo in range(0, int(edges[-1]), BLOCK):
            up = min(lo + BLOCK, int(edges[-1]))
            x = self.conv(line, lo, up)
            for s in range(int(np.searchsorted(edges, lo, "right")) - 1, int(np.searchsorted(edges, up, "left"))):
                a, b = max(int(edges[s]), lo), min(int(edges[s + 1]), up)
                if s % 4 < 3 and b > a:
                    part = x[a - lo : b - lo]
                    k = part.argmax(0)
                    top = part[k, every]
                    at[s], best[s] = np.where(top > best[s], a + k, at[s]), np.maximum(top, best[s])
        p = np.maximum(best, 0).reshape(n, 4, FILTERS)[:, :3].reshape(n, -1)
        h = np.tanh(p @ self.hidden + self.hidden_bias)
        z = h @ self.out + self.out_bias[0]
        y = 1 / (1 + np.exp(-z))
        loss = float(np.mean(np.logaddexp(0, z) - labels * z))
        dz = (y - labels) / n
        dh = dz[:, None] * self.out * (1 - h * h)
        dp = np.zeros((n, 4, FILTERS))
        dp[:, :3] = (dh @ self.hidden.T).reshape(n, 3, FILTERS)
        dp = dp.reshape(4 * n, FILTERS) * (best > 0)
        table = np.zeros_like(self.table)
        for j in range(WIDTH):
            np.add.at(table[j], (line[at + j], np.broadcast_to(every, at.shape)), dp)
        return loss, [table, dp.sum(0), p.T @ dh, dh.sum(0), h.T @ dz, dz.sum(keepdims=True)]


def lined(rows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """One line of codes, and the edges of left part, value, right part and gap of each row. Gaps as
    wide as a filter reaches keep rows apart; place ``i`` of the edges is the line's ``i + WIDTH // 2``."""
    half = WIDTH // 2
    gap = np.full(half, OUTSIDE, np.int16)
    parts, edges, at = [gap], [0], 0
    for row in rows:
        for text in row:
            parts.append(codes_of(text))
            at += len(parts[-1])
            edges.append(at)
        parts.append(gap)
        at += half
        edges.append(at)
    parts.append(gap)
    return np.concatenate(parts), np.array(edges)


def redrawn(value: str, rnd: random.Random) -> str:
    """A value of the same kind of length from one of the rules' alphabets."""
    which = rnd.randrange(3)
    if which == 0:
        return "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    alphabet = "0123456789abcdef" if which == 1 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    return "".join(rnd.choice(alphabet) for _ in range(max(HEX_LEAST, min(64, len(value)))))


def fold(value: str) -> int:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[0] % 5


def shown(secret: bool, row: tuple[str, str, str]) -> list[tuple[str, str, str]]:
    """The rows that a labelled candidate (left, value, right) teaches with; the same ones wherever it lies."""
    if not secret:
        return [row]
    left, value, right = row
    rnd = random.Random("\0".join((str(SEED), *row)).encode("utf-8", "surrogatepass"))
    new = redrawn(value, rnd)
    return [row, ("", value, ""), (left, new, right) if rnd.randrange(2) else ("", new, "")]


def batches_of(labels: np.ndarray, steps: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """At least ``steps`` batches, half of each from either label, in which every row comes at least once."""
    own = [w for w in (np.flatnonzero(labels == y) for y in (0, 1)) if len(w)]
    size = BATCH // len(own)
    steps = max(steps, *(-(-len(w) // size) for w in own))
    orders = [np.concatenate([rng.permutation(w) for _ in range(-(-steps * size // len(w)))]) for w in own]
    for t in range(steps):
        yield np.concatenate([o[t * size : (t + 1) * size] for o in orders])


def taught(net: Net, rows: list[tuple[str, str, str]], labels: np.ndarray, turn: int, seed: int = 0) -> None:
    """One round over a part's rows: Adam steps on ``net``."""
    m = [np.zeros_like(w) for w in net.weights()]
    v = [np.zeros_like(w) for w in net.weights()]
    batches = list(batches_of(labels, -(-STEPS // ROUNDS), np.random.default_rng([SEED, turn, seed])))
    for t, pick in enumerate(batches, 1):
        grads, lo, size = [np.zeros_like(w) for w in net.weights()], 0, 0
        for k, i in enumerate([*pick, None]):  # long rows in pieces, so that no more than some BLOCKs lie in memory
            if i is None or size > 4 * BLOCK:
                _, some = net.gradients([rows[j] for j in pick[lo:k]], labels[pick[lo:k]])
                for g, x in zip(grads, some):
                    g += x * ((k - lo) / len(pick))
                lo, size = k, 0
            size += sum(map(len, rows[i])) if i is not None else 0
        rate = RATE * (1 - 0.9 * (turn + t / len(batches)) / ROUNDS)
        for w, g, a, b in zip(net.weights(), grads, m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)


def fit(secrets: list[tuple[str, str, str]], others: list[tuple[str, str, str]]) -> Net | None:
    """The network for labelled rows (left, value, right) at hand, as one part; None if one label is missing.
    ``learn`` does the same over a table."""
    rows = [(r, 1, fold(row[1])) for row in sorted(secrets) for r in shown(True, row)]
    rows += [(row, 0, fold(row[1])) for row in sorted(others)]
    learned = [r for r in rows if r[2] > 1]
    if len({y for _, y, _ in learned}) < 2:
        return None
    net = Net.fresh()
    for turn in range(ROUNDS):
        taught(net, [r for r, _, _ in learned], np.array([y for _, y, _ in learned], float), turn)
    calibrate(net, [r for r in rows if r[2] == 0] or learned)
    held = [r for r in rows if r[2] == 1] or learned
    hit = accepts(net, [r[0] for r in held])
    truth = np.array([r[1] for r in held], bool)
    net.report = {"recall": float(hit[truth].mean()) if truth.any() else 1.0, "false_alarms": float(hit[~truth].mean()) if (~truth).any() else 0.0}
    return net


Sums = tuple[float, np.ndarray, np.ndarray]


def platt(ones: float, zeros: float) -> Generator[np.ndarray, Sums, None]:
    """Platt's line (slope, offset) by Newton steps that are halved until the loss falls: yields lines to try, takes
    their loss, gradient and curve, yields the last one accepted at the end."""
    line = np.array([0.0, np.log((ones + 1) / (zeros + 1))])
    loss, slope, curve = yield line
    for _ in range(50):
        step, size = np.linalg.solve(curve + 1e-6 * np.eye(2), slope), 1.0
        if np.abs(step).max() < 1e-9:
            break
        while size > 1e-6:
            new_loss, new_slope, new_curve = yield line - size * step
            if new_loss < loss:
                break
            size /= 2
        else:
            break
        line, loss, slope, curve, fell = line - size * step, new_loss, new_slope, new_curve, loss - new_loss
        if fell <= 1e-10 * abs(loss):
            break
    yield line


def calibrate(net: Net, rows: list[tuple[tuple[str, str, str], int, int]]) -> None:
    """Platt's line (targets a little inside 0 and 1), then the thresholds."""
    z, y = net.logits([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    ones, zeros = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    lines = platt(ones, zeros)
    line = next(lines)
    while True:
        p = 1 / (1 + np.exp(-np.clip(x @ line, -60, 60)))
        try:
            line = lines.send((float(np.sum(np.logaddexp(0, x @ line) - target * (x @ line))), x.T @ (p - target), x.T @ (x * (p * (1 - p))[:, None])))
        except StopIteration:
            break
    if line[0] > 0:
        net.slope, net.offset = float(line[0]), float(line[1])
    score = net.scores([r[0] for r in rows])
    shapes = np.array([shape(r[0][1]) for r in rows])
    net.thresholds = {}
    rest = float(np.quantile(score[y == 0], USUAL)) if zeros else 0.01
    for s in ("assign", "access", "hex"):
        own = np.sort(score[(y > 0) & (shapes == s)])
        if len(own) < ENOUGH:
            own = np.sort(score[y > 0])
        net.thresholds[s] = threshold(float(own[int(len(own) * (1 - RECALL))]) if len(own) else 1.0, rest)


def threshold(at: float, rest: float) -> float:
    """``at`` still finds enough secrets, ``rest`` is what usual other candidates reach."""
    odds = lambda p: float(np.log(p / (1 - p)))
    at, rest = (min(max(x, 0.01), 1 - 1e-9) for x in (at, rest))
    if rest < at:  # both sorts are apart: half way between them, in log odds
        at = float(1 / (1 + np.exp(-(odds(at) + odds(rest)) / 2)))
    return max(LEAST, at)


def half(value: str) -> int:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[1] % 2


def accepts(net: Net, rows: list[tuple[str, str, str]]) -> np.ndarray:
    return net.scores(rows) >= np.array([net.thresholds[shape(v)] for _, v, _ in rows], float)


# --- Spark ----------------------------------------------------------------------------------------

def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` less ``text``, with ``findings``: base spans and candidates with their surroundings."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ["kind", "start", "end", "left", "value", "right"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for texts in batches:
            for lo in range(0, len(texts), SLICE_ROWS):
                lists = [found_in(t) for t in texts.slice(lo, SLICE_ROWS).to_pylist()]
                flat = list(zip(*[f for fs in lists for f in fs])) or [[]] * 6
                rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, types)], names=names)
                yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), rows)

    common.prepare(docs.sparkSession)
    keep = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in (text.lower(), "findings")]
    return docs.select(*keep, F.arrow_udf(run, FOUND)(docs[f"`{text}`"]).alias("findings"))


def labelled(found: DataFrame) -> DataFrame:
    """``secret, left, value, right`` of each different base finding and candidate, with ``net`` (the network it
    teaches: that of the other half) and ``fold``."""
    each = found.select(F.explode("findings").alias("f")).select((F.col("f.kind") != "model").alias("secret"), "f.left", "f.value", "f.right")
    digest = F.sha2(F.col("value").cast("binary"), 256)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    return each.distinct().select("*", (1 - byte(1) % 2).alias("net"), (byte(0) % 5).alias("fold"))


def dealt(rows: DataFrame) -> tuple[DataFrame, dict[int, int]] | None:
    """The training rows in parts (``net, part, secret, left, value, right``), and how many parts each network has;
    None if a network lacks a label."""
    chars = F.sum(F.length("left") + F.length("value") + F.length("right"))
    seen = {(r["net"], r["secret"]): (r["n"], r["chars"]) for r in rows.groupBy("net", "secret").agg(F.count(F.lit(1)).alias("n"), chars.alias("chars")).collect()}
    nets = sorted({k for k, _ in seen})
    if not nets or any((k, y) not in seen for k in nets for y in (True, False)):
        return None
    parts, n_parts, copies = {}, F.lit(1), F.lit(1)
    for k in nets:
        (n, c), (m, d) = seen[k, True], seen[k, False]
        parts[k] = max(1, -(-(3 * n + m) // PART_ROWS), -(-(3 * c + d) // PART_CHARS))
        n_parts = F.when(F.col("net") == k, F.lit(parts[k])).otherwise(n_parts)
        for y, have in ((True, n), (False, m)):
            often = min(parts[k], -(-PART_LEAST * parts[k] // have))
            copies = F.when((F.col("net") == k) & (F.col("secret") == y), F.lit(often)).otherwise(copies)
    spread = F.explode(F.sequence(F.lit(0), copies - 1))
    each = rows.withColumn("__copy", spread).withColumn("part", F.pmod(F.xxhash64("left", "value", "right") + F.col("__copy"), n_parts).cast("int"))
    return each.select("net", "part", "secret", "left", "value", "right"), parts


def one_part(sent: Broadcast, turn: int) -> Callable[[pa.Table], pa.Table]:
    """A round of one part: the network that its rows make of the shared one."""

    def run(table: pa.Table) -> pa.Table:
        net, part = (table.column(c)[0].as_py() for c in ("net", "part"))
        got = sorted(zip(*(table.column(c).to_pylist() for c in ("left", "value", "right", "secret"))))
        rows = [(r, y) for *row, y in got for r in shown(y, tuple(row))]
        own = Net(*[w.copy() for w in sent.value[net].weights()])
        taught(own, [r for r, _ in rows], np.array([y for _, y in rows], float), turn, part)
        flat = np.concatenate([w.ravel() for w in own.weights()]).tobytes()
        columns = {"net": pa.array([net], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([len(rows)], pa.int64())}
        return pa.table({**columns, "weights": pa.array([flat], pa.binary())})

    return run


def trained(parts: DataFrame, counts: dict[int, int]) -> dict[int, Net]:
    """The networks after ``ROUNDS`` rounds over ``dealt`` rows."""
    nets = {k: Net.fresh() for k in counts}
    tasks = max(2 * sum(counts.values()), 8)
    for turn in range(ROUNDS):
        sent = parts.sparkSession.sparkContext.broadcast(nets)
        out = parts.repartition(tasks, "net", "part").groupBy("net", "part").applyInArrow(one_part(sent, turn), "net int, part int, n long, weights binary")
        came = sorted(out.collect(), key=lambda r: (r["net"], r["part"]))
        for k, net in nets.items():
            own = [r for r in came if r["net"] == k]
            total, at = sum(r["n"] for r in own), 0
            flat = sum(np.frombuffer(r["weights"]) * (r["n"] / total) for r in own)
            for w in net.weights():
                w[...] = flat[at : at + w.size].reshape(w.shape)
                at += w.size
        sent.unpersist()
    return nets


def logits(rows: DataFrame, nets: dict[int, Net]) -> DataFrame:
    """``net, fold, secret, shape, z`` of each row shown."""
    sent = rows.sparkSession.sparkContext.broadcast(nets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                got = batch.slice(lo, SLICE_ROWS).to_pylist()
                each = [(g["net"], g["fold"], g["secret"], r) for g in got for r in shown(g["secret"], (g["left"], g["value"], g["right"]))]
                for k, net in sent.value.items():
                    own = sorted((e for e in each if e[0] == k), key=lambda e: len(e[3][1]))
                    a = size = 0
                    for i, e in enumerate([*own, None]):
                        if e is None or size > BLOCK:
                            z = net.logits([x[3] for x in own[a:i]])
                            cols = [[x[0] for x in own[a:i]], [x[1] for x in own[a:i]], [x[2] for x in own[a:i]], [shape(x[3][1]) for x in own[a:i]], z]
                            types = (pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.float64())
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["net", "fold", "secret", "shape", "z"])
                            a, size = i, 0
                        size += len(e[3][1]) + 2 * AROUND if e else 0

    return rows.select("net", "fold", "secret", "left", "value", "right").mapInArrow(run, "net int, fold int, secret boolean, shape string, z double")


def by_net(values: dict[int, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(values.items()) for x in (k, float(v))]), F.col("net"))


def calibrated(nets: dict[int, Net], z: DataFrame) -> None:
    """``calibrate`` over a table of ``logits``: sums for Platt's line, exact places in order for the thresholds."""
    kinds = ("assign", "access", "hex")
    counts = z.groupBy("net").agg(*[F.count_if(F.col("secret") & (F.col("shape") == s)).alias(s) for s in kinds],
                                  F.count_if("secret").alias("all"), F.count_if(~F.col("secret")).alias("rest")).collect()
    n = {r["net"]: r.asDict() for r in counts}
    one, zero = ({k: f(n[k]) for k in nets} for f in (lambda r: (r["all"] + 1) / (r["all"] + 2), lambda r: 1 / (r["rest"] + 2)))
    tries = {k: platt(n[k]["all"], n[k]["rest"]) for k in nets}
    lines = {k: next(t) for k, t in tries.items()}
    while tries:
        margin = by_net({k: x[0] for k, x in lines.items()}) * F.col("z") + by_net({k: x[1] for k, x in lines.items()})
        target = F.when(F.col("secret"), by_net(one)).otherwise(by_net(zero))
        each = z.where(F.col("net").isin(*tries)).select("net", "z", margin.alias("m"), target.alias("t"))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("m")))))
        c, d = p * (1 - p), p - F.col("t")
        loss = F.greatest(F.col("m"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("m"))) - F.col("t") * F.col("m")
        sums = each.groupBy("net").agg(F.sum(loss).alias("loss"), F.sum(c * F.col("z") * F.col("z")).alias("zz"), F.sum(c * F.col("z")).alias("z1"),
                                       F.sum(c).alias("c"), F.sum(d * F.col("z")).alias("dz"), F.sum(d).alias("d")).collect()
        for r in sums:
            try:
                lines[r["net"]] = tries[r["net"]].send((r["loss"], np.array([r["dz"], r["d"]]), np.array([[r["zz"], r["z1"]], [r["z1"], r["c"]]])))
            except StopIteration:
                del tries[r["net"]]
    for k, net in nets.items():
        if lines[k][0] > 0:
            net.slope, net.offset = map(float, lines[k])
    wanted = [(k, "rest", int(f((n[k]["rest"] - 1) * USUAL))) for k in nets if n[k]["rest"] for f in (np.floor, np.ceil)]
    wanted += [(k, s, int(n[k][s] * (1 - RECALL))) for k in nets for s in (*kinds, "all") if n[k][s]]
    spark = z.sparkSession
    group = F.explode(F.when(F.col("secret"), F.array(F.col("shape"), F.lit("all"))).otherwise(F.array(F.lit("rest"))))
    places = spark.createDataFrame(sorted(set(wanted)), "net int, __group string, __k long")
    got = {(r["net"], r["__group"], r["__k"]): r["value"] for r in select_ranks(z.select("net", group.alias("__group"), "z"), ["net", "__group"], "z", places).collect()}
    for k, net in nets.items():
        score = lambda x: float(1 / (1 + np.exp(-np.clip(net.slope * x + net.offset, -60, 60))))  # noqa: B023, E731
        rest = 0.01
        if n[k]["rest"]:
            at = (n[k]["rest"] - 1) * USUAL
            low, high = (score(got[k, "rest", int(f(at))]) for f in (np.floor, np.ceil))
            rest = low + (high - low) * (at - np.floor(at))
        net.thresholds = {}
        for s in kinds:
            own = s if n[k][s] >= ENOUGH else "all"
            net.thresholds[s] = threshold(score(got[k, own, int(n[k][own] * (1 - RECALL))]) if n[k][own] else 1.0, rest)


def reported(nets: dict[int, Net], z: DataFrame) -> None:
    """The share of secrets found, and of others taken for secrets, in a table of ``logits``."""
    margin = by_net({k: x.slope for k, x in nets.items()}) * F.col("z") + by_net({k: x.offset for k, x in nets.items()})
    limit = F.lit(2.0)
    for s in ("assign", "access", "hex"):
        limit = F.when(F.col("shape") == s, by_net({k: x.thresholds[s] for k, x in nets.items()})).otherwise(limit)
    hit = (1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), margin)))) >= limit).cast("double")
    for r in z.groupBy("net").agg(F.avg(F.when(F.col("secret"), hit)).alias("hit"), F.avg(F.when(~F.col("secret"), hit)).alias("false")).collect():
        nets[r["net"]].report = {"recall": 1.0 if r["hit"] is None else r["hit"], "false_alarms": r["false"] or 0.0}


def learn(found: DataFrame) -> list[Net] | None:
    """The networks that judge values of half 0 and 1, each trained on all different candidates of the other
    half. With too few labels in a half all of them train one network for both."""
    common.prepare(found.sparkSession)
    rows = common.stage(labelled(found), "secret-labels")
    staged, parted = [rows], dealt(rows.where("fold > 1"))
    if parted is None or len(parted[1]) < 2:
        rows = rows.withColumn("net", F.lit(0))
        parted = dealt(rows.where("fold > 1"))
    nets = None
    if parted is not None:
        parts = common.stage(parted[0], "secret-parts")
        nets = trained(parts, parted[1])
        has = {(r["net"], r["fold"]) for r in rows.where("fold < 2").select("net", "fold").distinct().collect()}
        wanted = F.col("fold") < 2
        for k in nets:  # without rows of a fold, those that were learned from stand for it
            if not {(k, 0), (k, 1)} <= has:
                wanted = wanted | (F.col("net") == k)
        z = common.stage(logits(rows.where(wanted), nets), "secret-logits")
        staged += [parts, z]
        of = lambda f: reduce(or_, [(F.col("net") == k) & (F.col("fold") == f if (k, f) in has else F.col("fold") > 1) for k in nets])
        calibrated(nets, z.where(of(0)))
        reported(nets, z.where(of(1)))
    for t in staged:
        common.unstage(t)
    return None if nets is None else [nets[0], nets[max(nets)]]


def scored(found: DataFrame, nets: list[Net] | None) -> DataFrame:
    """``found`` with the ``findings`` that stay: ``kind, start, end, value, score`` (null for base spans)."""
    sent = found.sparkSession.sparkContext.broadcast(nets)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        names = ["kind", "start", "end", "value", "score"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
        for lists in batches:
            for lo in range(0, len(lists), SLICE_ROWS):
                part = [fs or [] for fs in lists.slice(lo, SLICE_ROWS).to_pylist()]
                asked = [f for fs in part for f in fs if f["kind"] == "model"]
                told = dict(zip(map(id, asked), judged(model, asked)))
                edges, flat = [0], []
                for fs in part:
                    stay = [(f["kind"], f["start"], f["end"], f["value"], told.get(id(f), (True, None))[1]) for f in fs if told.get(id(f), (True,))[0]]
                    flat += sorted(stay, key=lambda f: (f[1], KINDS.index(f[0])))
                    edges.append(len(flat))
                rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*flat)) or [[]] * 5, types)], names=names)
                yield pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows)

    keep = [found[f"`{c}`"] for c in found.columns if c != "findings"]
    return found.select(*keep, F.arrow_udf(run, FINDINGS)(found["findings"]).alias("findings"))


def judged(nets: list[Net] | None, asked: list[dict]) -> list[tuple[bool, float | None]]:
    """For each candidate whether it is a secret, and its score. Equal ones are scored once."""
    if nets is None or not asked:
        return [(False, None)] * len(asked)
    rows = [(f["left"], f["value"], f["right"]) for f in asked]
    known: dict[tuple[str, str, str], tuple[bool, float]] = {}
    for h, net in enumerate(nets):
        unlike = sorted({r for r in rows if half(r[1]) == h}, key=lambda r: (len(r[1]), r))
        lo = size = 0
        for i, r in enumerate([*unlike, None]):  # some BLOCK places at a time
            if r is None or size > BLOCK:
                score = net.scores(unlike[lo:i]).tolist()
                known.update((x, (y >= net.thresholds[shape(x[1])], y)) for x, y in zip(unlike[lo:i], score))
                lo, size = i, 0
            size += len(r[1]) + 2 * AROUND if r else 0
    return [known[r] for r in rows]


def findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` less ``text``, with ``findings``: all spans with kind, place (code points), value, score."""
    found = common.stage(candidates(docs, text), "secret-candidates")
    return scored(found, learn(found))


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, and ``n_model``."""
    out = findings(docs.select("doc_id", "text"))
    line = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda f: f["kind"] != "model")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
                      line(F.col("findings")).alias("spans"), count("model"))
