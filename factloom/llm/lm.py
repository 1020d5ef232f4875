"""Scoring by a gated recurrent language model with a class-factored output.

Words are lower-cased (A-Z) and each text ends in one end token. Training tokens with a share of KNOWN or more
have ids, so the corpus sets how many (1 / KNOWN at most); all other words share one more id. Ids are dealt
into classes of about equal summed root frequency, as many as the root of the number of ids; the shared id is a
class by itself. A gated recurrent unit reads the previous id; from its state one softmax gives the class and a
second one the id within the class. A word of the shared class has its smoothed unigram share of that class.
Nothing is cut off: the state is carried across windows from a document's first token to its last.

Training is truncated backpropagation in numpy over every token of every training document: each task starts
from the same weights, which already equal the class unigrams, runs over its own documents in windows of STEPS
tokens on LANES lanes, and the tasks' weights are averaged by their numbers of tokens. So scores depend a little
on how the input is split into tasks. In training a lane starts with an empty state, also inside a document.

Counts are exact over all training texts. Words with a share of SHARE or more (so at most 1 / SHARE of them)
are broadcast; the rest meet their counts in a join, in which by that bound no word is common.

Cases: a null text counts as empty and is one end token; without training documents N and V are 0 and every
token has the base probability 1; repeated rows and null ids (the empty text in the fold) are rows of their
own; an empty table gives an empty table; columns besides id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fold, materialize, sliced, table

KNOWN, HIDDEN = 2e-5, 16
STEPS, LANES, RATE = 16, 512, 0.1
SHARE = 1e-6
BUFFER = 400_000
#: Tokens that are scored together, of several batches: one long document leaves few lanes to a small batch.
TOGETHER = 1_500_000
END = ""
_FLUSH = 300_000
#: Weights that a row of the averaging holds.
PART = 8192


def by_number(numbers: np.ndarray) -> np.ndarray:
    """The stable order of ids or classes. All are under 1 / KNOWN + 2, and numpy sorts 16 bits by counting, not comparing."""
    return np.argsort(numbers.astype(np.uint16) if len(numbers) and numbers.max() < 1 << 16 else numbers, kind="stable")


class Network:
    """Weights by name. word_class and first give each id's class and each class's first id."""

    def __init__(self, counts: np.ndarray):
        """counts: of the ids in descending order, the shared id's last."""
        k = len(counts) - 1
        classes = max(2, round(math.sqrt(len(counts))))
        root = np.sqrt(np.maximum(counts[:k], 1.0))
        share = np.cumsum(root) / max(root.sum(), 1e-9)
        cls = np.minimum(((share - root / max(root.sum(), 1e-9) / 2) * (classes - 1)).astype(np.int64), classes - 2)
        used, self.word_class = np.unique(np.append(cls, classes - 1), return_inverse=True)
        self.first = np.searchsorted(self.word_class, np.arange(len(used) + 1))
        r = np.random.default_rng(5)
        c = np.maximum(counts.astype(np.float64), 0.5)
        per_class = np.add.reduceat(c, self.first[:-1])
        n = len(used)
        self.w = {
            "x": r.normal(0, 0.3, (k + 1, 3 * HIDDEN)),
            "u": r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)),
            "c": np.zeros((HIDDEN, n)),
            "cb": np.log(per_class / per_class.sum()),
            "o": np.zeros((k + 1, HIDDEN)),
            "ob": np.log(c / per_class[self.word_class]),
        }
        self.w = {key: v.astype(np.float32) for key, v in self.w.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for key, v in self.w.items():
            self.w[key] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def step(self, prev: np.ndarray, h: np.ndarray):
        g, a = self.w["x"].take(prev, axis=0), h @ self.w["u"]
        zr = g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, inner = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, 2 * HIDDEN :]
        n = r * inner
        n += g[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, inner

    def output(self, h: np.ndarray, ids: np.ndarray, learn: dict | None = None):
        """(log P of each id from its state, None); with learn, the gradients go there and (None, those of the states) come back.

        Biases are the weights of a last state of 1. A softmax stays undivided: its sums divide what is made of it.
        """
        w, n = self.w, len(ids)
        one = np.ones((n, 1), h.dtype)
        inner, outer = np.concatenate([w["c"], w["cb"][None]]), np.concatenate([w["o"], w["ob"][:, None]], axis=1)
        ones, places = np.ones(max(inner.shape[1], int(np.diff(self.first).max())), h.dtype), np.arange(n)
        # states lie within -1 and 1, so most weights need no shift
        shift = max(np.abs(inner).sum(axis=0).max(), np.abs(outer).sum(axis=1).max()) > 60

        def soft(states, weights):
            p = states @ weights
            if shift:
                p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            return p, p @ ones[: p.shape[1]]

        cls = self.word_class[ids]
        h = np.concatenate([h, one], axis=1)
        if learn is None:
            share, total, dh = np.empty(n, h.dtype), np.empty(n, h.dtype), None
            for at in range(0, n, 4096):  # so few rows that the softmax stays in the cache
                p, total[at : at + 4096] = soft(h[at : at + 4096], inner)
                share[at : at + 4096] = p[places[: len(p)], cls[at : at + 4096]]
        else:
            p, total = soft(h, inner)
            share = p[places, cls]
            p[places, cls] -= total
            whole = (h / total[:, None]).T @ p
            learn["c"], learn["cb"] = whole[:-1], whole[-1]
            dh = (p @ w["c"].T) / total[:, None]
            moves = np.zeros_like(outer)
        share = share / total
        order = by_number(cls)
        bounds = np.searchsorted(cls[order], np.arange(len(self.first)))
        sorted_h, sorted_ids, within = h.take(order, axis=0), ids[order] - self.first[cls[order]], np.ones(n, share.dtype)
        back = np.zeros((n, HIDDEN), h.dtype) if learn is not None else None
        first, bounds = self.first.tolist(), bounds.tolist()
        for k in range(len(first) - 1):
            a, b = first[k], first[k + 1]
            i, j = bounds[k], bounds[k + 1]
            if b - a < 2 or i == j:
                continue
            hs, want, each = sorted_h[i:j], sorted_ids[i:j], places[: j - i]
            p, total = soft(hs, outer[a:b].T)
            if learn is None:
                within[i:j] = p[each, want] / total
                continue
            p[each, want] -= total
            within[i:j] = by = 1 / total
            np.matmul(p.T, hs * by[:, None], out=moves[a:b])
            np.matmul(p, w["o"][a:b], out=back[i:j])
        if learn is not None:
            learn["o"], learn["ob"] = moves[:, :-1], moves[:, -1]
            back *= within[:, None]
            dh[order] += back
            return None, dh
        out, tiny = np.empty(n), 1e-37
        out[order] = within
        return np.log(np.maximum(out, tiny)) + np.log(np.maximum(share, tiny)), None

    def train(self, stream: np.ndarray, end: int, sums: dict) -> None:
        """One pass of windows over a stream of documents, each closed by end."""
        lanes = max(1, min(LANES, len(stream) // STEPS))
        length, longer = divmod(len(stream), lanes)  # the first `longer` lanes have one token more
        cut = longer * (length + 1)
        ids = np.full((length + (longer > 0), lanes), -1)
        ids[:length, longer:] = stream[cut:].reshape(lanes - longer, length).T
        if longer:
            ids[:, :longer] = stream[:cut].reshape(longer, length + 1).T
        prev = np.vstack([np.full((1, lanes), end), ids[:-1]])
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, len(ids), STEPS):
            x, y = prev[at : at + STEPS], ids[at : at + STEPS]
            keep = (x != end)[:, :, None].astype(np.float32)
            trace, states = [], np.empty((len(x), lanes, HIDDEN), h.dtype)
            befores = np.empty_like(states)
            for t in range(len(x)):
                befores[t] = h = h * keep[t]
                h, *inner = self.step(x[t], h)
                states[t] = h
                trace.append(inner)
            learn: dict = {}
            real = y.ravel() >= 0
            flat_states = states.reshape(-1, HIDDEN)
            if real.all():
                dout = self.output(flat_states, y.ravel(), learn)[1]
            else:
                dout = np.zeros((x.size, HIDDEN), h.dtype)
                _, dout[real] = self.output(flat_states[real], y.ravel()[real], learn)
            dout = dout.reshape(len(x), lanes, HIDDEN)
            dx, last, later = np.empty((len(x), lanes, 3 * HIDDEN), h.dtype), slice(2 * HIDDEN, None), 0
            dn_r, back = np.empty_like(states), self.w["u"].T.copy()
            for t in range(len(x) - 1, -1, -1):
                z, r, n, inner = trace[t]
                d = dout[t] + later
                dn = d * (1 - z)
                dx[t, :, :HIDDEN] = dn * z * (befores[t] - n)
                dn *= 1 - n * n
                np.multiply(dn, r, out=dn_r[t])
                dx[t, :, HIDDEN : 2 * HIDDEN] = dn_r[t] * inner * (1 - r)
                dx[t, :, last] = dn
                later = (d * z + dx[t, :, : 2 * HIDDEN] @ back[: 2 * HIDDEN] + dn_r[t] @ back[last]) * keep[t]
            dx, befores = dx.reshape(-1, 3 * HIDDEN), befores.reshape(-1, HIDDEN)
            learn["u"] = np.concatenate([befores.T @ dx[:, : 2 * HIDDEN], befores.T @ dn_r.reshape(-1, HIDDEN)], axis=1)
            flat_ids = x.ravel()
            order = by_number(flat_ids)
            in_order = flat_ids[order]
            starts = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1]))
            seen = in_order[starts]
            size = int(real.sum())
            self._move("x", np.add.reduceat(dx[order], starts) / size, sums, seen)
            for key, v in learn.items():
                self._move(key, v / size, sums)

    def _move(self, key: str, g: np.ndarray, sums: dict, rows=slice(None)) -> None:
        """One adaptive step along a gradient; rows not given have none."""
        if key not in sums:
            sums[key] = np.full_like(self.w[key], 1e-8)
        held = g * g
        held += sums[key][rows]
        sums[key][rows] = held
        np.sqrt(held, out=held)
        np.divide(RATE * g, held, out=held)
        self.w[key][rows] -= held

    def score(self, docs: list[np.ndarray], end: int) -> np.ndarray:
        """Natural log-likelihood of each document, the sum over all its tokens."""
        if not docs:
            return np.empty(0)
        lengths = np.array([len(d) for d in docs])
        width = min(LANES, len(docs), -(-2 * int(lengths.sum()) // int(lengths.max())))  # a long document must not widen all lanes
        lanes: list[list[int]] = [[] for _ in range(width)]
        load = np.zeros(len(lanes), np.int64)
        for i in np.argsort(-lengths, kind="stable"):
            k = int(load.argmin())
            lanes[k].append(int(i))
            load[k] += lengths[i]
        order = np.argsort(-load, kind="stable")
        lanes, load = [lanes[k] for k in order], load[order]
        ids = np.full((int(load[0]), len(lanes)), end)
        for k, lane in enumerate(lanes):
            ids[: load[k], k] = np.concatenate([docs[i] for i in lane])
        active = np.searchsorted(-load, -np.arange(int(load[0])), "left")  # lanes longer than t
        out = np.zeros(ids.shape)
        h = np.zeros((HIDDEN, len(lanes)), self.w["u"].dtype)
        states, spots, gates = [], [], slice(0, 2 * HIDDEN)
        sign = np.repeat(np.float32([-1, 1]), [2 * HIDDEN, HIDDEN])  # step() with lanes as columns and the gates' sums negated in the weights
        x, u = self.w["x"] * sign, (self.w["u"] * sign).T.copy()
        for t in range(len(ids)):
            n = active[t]
            if t % 16 == 0:  # what the coming steps read, gathered at once, and so little that it stays in the cache
                before = np.vstack([np.full((1, len(lanes)), end) if t == 0 else ids[t - 1 : t], ids[t : t + 15]])[:, :n]
                read, keep = x.take(before, axis=0).transpose(0, 2, 1).copy(), (before != end).astype(h.dtype)
                going = keep.all(axis=1).tolist()
            at = t % 16
            h = h[:, :n] if going[at] else h[:, :n] * keep[at, :n]
            g, a = read[at, :, :n], u @ h
            a[gates] += g[gates]
            zr, new = a[gates], a[2 * HIDDEN :]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            new *= zr[HIDDEN:]
            new += g[2 * HIDDEN :]
            np.tanh(new, out=new)
            h = h - new
            h *= zr[:HIDDEN]
            h += new
            states.append(h)
            spots.append(n)
            if len(states) == 64 or t + 1 == len(ids):
                first = t + 1 - len(states)
                got = self.output(np.concatenate(states, axis=1).T, np.concatenate([ids[first + k, :m] for k, m in enumerate(spots)]))[0]
                at = 0
                for k, m in enumerate(spots):
                    out[first + k, :m] = got[at : at + m]
                    at += m
                states, spots = [], []
        sums = np.empty(len(docs))
        for k, lane in enumerate(lanes):
            ends = np.cumsum(lengths[lane])
            sums[lane] = np.add.reduceat(out[: load[k], k], np.concatenate([[0], ends[:-1]]))
        return sums


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts in one array, none of them a Python object, and the number of each text's words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, bounds = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    real = pc.not_equal(words, "")  # white space at an end gives an empty one
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return words.filter(real), np.diff(before[bounds])


def token_counts(docs: DataFrame) -> DataFrame:
    """`word`, `c` over all texts given; the end token is the empty word. A task sums before it sends."""

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in sliced(batches):
            found = pc.value_counts(tokens(batch.column(0))[0])
            held += [pa.table([found.field(0), found.field(1)], ["word", "c"]), pa.table([[END], [batch.num_rows]], ["word", "c"])]
            size += len(found)
            if size > 2 * _FLUSH:
                held = [summed(held)]
                size = held[0].num_rows
                if size > _FLUSH:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from summed(held).to_batches()

    def summed(held):
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The broadcast head: index of a word, its count, its id in the network (the shared id is the last)."""

    def __init__(self, head: list[tuple[str, int]], total: int, distinct: int):
        last = END.encode()
        head = sorted(((w.encode(), c) for w, c in head), key=lambda x: (-x[1], x[0]))
        top = [x for x in head if x[0] == last or x[1] >= KNOWN * total]
        top = sorted(top if last in dict(top) else [*top, (last, 0)], key=lambda x: (-x[1], x[0]))
        taken = dict(top)
        rest = [x for x in head if x[0] not in taken]
        self.words = pa.array([w for w, _ in top + rest], pa.binary()).cast(pa.string())
        self.counts = np.array([c for _, c in top + rest], np.int64)
        self.size, self.end = len(top), [w for w, _ in top].index(last)
        self.total, self.distinct = total, distinct
        shared = total - int(self.counts[: self.size].sum())
        self.log_shared = math.log10(max(1, shared + distinct - self.size + 1))
        self.net_counts = np.append(self.counts[: self.size], shared)
        self.log_base = math.log10(total + distinct + 1)

    def all_ids(self, texts: pa.Array, known: int | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all tokens of the texts among the first `known` words (-1: none of them), each text's number of tokens, the words."""
        words, sizes = tokens(texts)
        found = pc.fill_null(pc.index_in(words, self.words[:known]), -1).to_numpy()
        ids, inner = np.full(len(words) + len(sizes), self.end), np.ones(len(words) + len(sizes), bool)
        inner[np.cumsum(sizes + 1) - 1] = False
        ids[inner] = found
        return ids, sizes + 1, words

    def ids(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        ids, _, words = self.all_ids(pa.array([text], pa.string()))
        return words.cast(pa.binary()).to_pylist(), ids

    def all_network_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """for_network() of all_ids(), by the few words that have ids there."""
        ids, sizes, _ = self.all_ids(texts, self.size)
        return self.for_network(ids), sizes

    def network_ids(self, text: str | None) -> np.ndarray:
        return self.all_network_ids(pa.array([text], pa.string()))[0]

    def for_network(self, ids: np.ndarray) -> np.ndarray:
        return np.where((ids < 0) | (ids >= self.size), self.size, ids)


def trained(docs: DataFrame, sent) -> np.ndarray:
    """Averaged weights of one pass of each task over its documents."""

    def run(batches):
        vocab = sent.value
        net, sums, held, size, seen = Network(vocab.net_counts), {}, [], 0, 0
        for batch in sliced(batches):
            ids, sizes = vocab.all_network_ids(batch.column(0))
            done = 0
            for end in np.cumsum(sizes).tolist():
                if size + end - done >= BUFFER:
                    net.train(np.concatenate([*held, ids[done:end]]), vocab.end, sums)
                    held, seen, size, done = [], seen + size + end - done, 0, end
            held.append(ids[done:])
            size += len(ids) - done
        if size:
            net.train(np.concatenate(held), vocab.end, sums)
        if seen + size:
            flat = net.flat().astype(np.float64) * (seen + size)
            parts = [flat[i : i + PART].tobytes() for i in range(0, len(flat), PART)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen + size] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names)

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for k, n, v in zip(*(c.to_pylist() for c in batch.columns)):
                held = sums.setdefault(k, [0, 0.0])
                held[0] += n
                held[1] = held[1] + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())], names)

    names = ["k", "n", "v"]
    found = docs.select("text").mapInArrow(run, "k int, n long, v binary").repartition("k").mapInArrow(add, "k int, n long, v binary").collect()  # the weights once
    if not found:
        return Network(sent.value.net_counts).flat()
    return np.round(np.concatenate([np.frombuffer(r["v"]) / r["n"] for r in sorted(found, key=lambda r: r["k"])]), 6)


def score_batches(batches, vocab: Vocabulary, weights: np.ndarray):
    """A task's rows with what the head of the vocabulary and the network give them; `tail`: the words of the rest."""
    net = Network(vocab.net_counts)
    net.load(weights)
    logs, seen = np.log10(vocab.counts + 1.0), vocab.counts > 0
    out, nets, size = [], [], 0

    def together():
        rows = pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        model = net.score(nets, vocab.end) / math.log(10)
        return rows.set_column(5, "model", pa.array(model + rows.column(5).to_numpy()))

    for batch in sliced(batches):
        ids, sizes, words = vocab.all_ids(batch.column(2))
        starts, rest, shared = np.cumsum(sizes) - sizes, ids < 0, (ids < 0) | (ids >= vocab.size)
        each = np.where(rest, 0.0, logs[ids])
        base = np.add.reduceat(each, starts) - sizes * vocab.log_base
        model = np.add.reduceat(np.where(shared, each, 0.0), starts) - np.add.reduceat(shared, starts, dtype=np.int64) * vocab.log_shared
        known = np.add.reduceat(~rest & seen[ids], starts, dtype=np.int64)
        inner = np.ones(len(ids), bool)
        inner[starts + sizes - 1] = False
        n_tail = np.append(0, np.cumsum(np.add.reduceat(rest, starts, dtype=np.int64)))
        tail = pa.ListArray.from_arrays(pa.array(n_tail, pa.int32()), words.filter(pa.array(rest[inner])))
        out.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(known), pa.array(base), pa.array(model), tail], ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "tail"]))
        nets += np.split(vocab.for_network(ids), starts[1:])
        size += len(ids)
        if size >= TOGETHER:
            yield together()
            out, nets, size = [], [], 0
    if out:
        yield together()


def scored(docs: DataFrame, held_out) -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` of every row."""
    spark = docs.sparkSession
    # small products: more threads of the linear algebra library than the one of the task only wait for each other
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text")
    train = rows.where(~F.col("held_out"))
    counts = materialize(token_counts(train), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = counts.where((F.col("c") >= SHARE * total) | (F.col("word") == END)).collect()  # 1 / SHARE rows at most
    vocab = Vocabulary([tuple(r) for r in head], total, distinct)
    sent = spark.sparkContext.broadcast(vocab)
    weights = spark.sparkContext.broadcast(trained(train, sent))

    def run(batches):
        yield from score_batches(batches, sent.value, weights.value)

    made = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, tail array<string>")
    made = materialize(made.withColumn("row", F.monotonically_increasing_id()), "scored")
    tails = made.select("row", F.explode("tail").alias("word")).join(counts, "word")  # a word never seen in training adds log10(0 + 1)
    more = tails.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("seen"))
    add = F.coalesce("more", F.lit(0.0))
    return made.drop("tail").join(more, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("model") + add).alias("score"))


def op8_recurrent_lm(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)
