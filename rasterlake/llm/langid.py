"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the lower-cased UTF-8 bytes of a whole text, forwards and backwards,
and gives every position a probability for each language; a document's probabilities
are the mean over all its positions.  Its units are gated recurrent units with an update
gate, a reset gate (on the recurrent part of the candidate) and a candidate, all squashed
by softsigns.

The state is carried through the text.  To run many places at a time, a text is dealt
into chunks of ``CHUNK`` bytes, each of which starts ``WARM`` bytes early (in reverse:
late) from a zero state.  What state the chunk then has is compared with the one that
its neighbour ended with; where any unit differs by more than ``TOLERANCE``, the chunk
is run again from the neighbour's state, until all agree.

Training is backpropagation through time in numpy on the driver.  It is the only part
with bounds: windows of ``WINDOW`` bytes, ``PER_DOC`` at random places of each of
``per_lang`` documents of every language (fewer, where all would be over ``MAX_DOCS``),
cut in the tasks, so that no whole text comes to the driver.  Every language that a
learnable row names can be predicted.

Defined cases: null texts and texts without a letter (Unicode category L) are ``und``
with score 0; a null id is a training row like any other; without any labelled row
everything is ``und``; repeated rows are labelled each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import held_out, small_batches, text_of, trim

EMBED, HIDDEN = 12, 16
CHUNK, WARM, TOLERANCE = 512, 64, 0.02
#: Chunks that are run at a time, and the multiple that their number is filled up to.
BATCH, PAD = 512, 32
WINDOW, PER_DOC, MAX_DOCS = 64, 12, 40_000
_WORDY = re.compile(r"[^\W\d_]")


def _soft(x):
    """The softsign, in place of tanh and (moved to 0..1) of the logistic function: it needs no exponential."""
    return x / (1 + np.abs(x))


def init_direction(rng) -> dict[str, np.ndarray]:
    """Weights of one direction: input, recurrent, bias; columns for update gate, reset gate, candidate."""
    return {
        "w": rng.normal(0, 0.3, (EMBED, 3 * HIDDEN)).astype(np.float32),
        "u": (rng.normal(0, 1, (HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32),
        "b": np.zeros(3 * HIDDEN, np.float32),
    }


def forward(p: dict, xs: np.ndarray, keep: bool = False):
    """States (T, B, H) of one direction for inputs ``xs`` (T, B, 3H); with ``keep`` also what the backward pass needs."""
    steps, batch, _ = xs.shape
    h = np.zeros((batch, HIDDEN), np.float32)
    out = np.empty((steps, batch, HIDDEN), np.float32)
    kept = []
    for t in range(steps):
        hu = h @ p["u"]
        gates = 0.5 + 0.5 * _soft(xs[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r, hn = gates[:, :HIDDEN], gates[:, HIDDEN:], hu[:, 2 * HIDDEN :]
        n = _soft(xs[t, :, 2 * HIDDEN :] + r * hn)
        if keep:
            kept.append((h, z, r, hn, n))
        out[t] = h = n + z * (h - n)
    return (out, kept) if keep else out


def backward(p: dict, kept: list, dout: np.ndarray):
    """Gradients of inputs and recurrent weights from those of the states, through time."""
    steps, batch, _ = dout.shape
    dxs = np.empty((steps, batch, 3 * HIDDEN), np.float32)
    du = np.zeros_like(p["u"])
    dh = np.zeros((batch, HIDDEN), np.float32)
    for t in reversed(range(steps)):
        h, z, r, hn, n = kept[t]
        d = dh + dout[t]
        dn = d * (1 - z) * (1 - np.abs(n)) ** 2
        dz = d * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dn * hn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        dxs[t] = np.concatenate([dz, dr, dn], 1)
        dhu = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ dhu
        dh = d * z + dhu @ p["u"].T
    return dxs, du


def train(words: list[bytes], labels: np.ndarray, n_langs: int, epochs: int = 6, batch: int = 256, rate: float = 0.006, seed: int = 7) -> dict:
    """Fit the network to pieces of text (their bytes) and their language numbers by per-position cross-entropy."""
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "o": rng.normal(0, 0.2, (2 * HIDDEN, n_langs)).astype(np.float32), "ob": np.zeros(n_langs, np.float32)}
    for side in "fb":
        p |= {f"{side}{k}": v for k, v in init_direction(rng).items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    by_len: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_len.setdefault(len(w), []).append(i)
    step = 0
    todo = [np.array(v) for v in by_len.values()]
    total = epochs * sum(-(-len(v) // batch) for v in todo)
    for _ in range(epochs):
        batches = []
        for idx in todo:
            perm = rng.permutation(idx)
            batches += [perm[k : k + batch] for k in range(0, len(perm), batch)]
        for k in rng.permutation(len(batches)):
            idx = batches[k]
            x = np.frombuffer(b"".join([words[i] for i in idx]), np.uint8).reshape(len(idx), -1).T
            y = labels[idx]
            g = {k: np.zeros_like(v) for k, v in p.items()}
            emb = p["e"][x]
            outs, keeps = [], []
            for side in "fb":
                q = {"u": p[f"{side}u"]}
                xs = emb if side == "f" else emb[::-1]
                o, kept = forward(q, xs @ p[f"{side}w"] + p[f"{side}b"], True)
                outs.append(o if side == "f" else o[::-1])
                keeps.append(kept)
            both = np.concatenate(outs, 2)
            logits = both @ p["o"] + p["ob"]
            logits -= logits.max(2, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(2, keepdims=True)
            prob[:, np.arange(len(idx)), y] -= 1
            d = (prob / prob.shape[0] / len(idx)).astype(np.float32)
            g["o"] = np.tensordot(both, d, ((0, 1), (0, 1)))
            g["ob"] = d.sum((0, 1))
            dboth = d @ p["o"].T
            demb = np.zeros_like(emb)
            for j, side in enumerate("fb"):
                dout = dboth[:, :, j * HIDDEN : (j + 1) * HIDDEN]
                xs = emb if side == "f" else emb[::-1]
                dxs, du = backward({"u": p[f"{side}u"]}, keeps[j], dout if side == "f" else dout[::-1])
                g[f"{side}u"] = du
                g[f"{side}w"] = np.tensordot(xs, dxs, ((0, 1), (0, 1)))
                g[f"{side}b"] = dxs.sum((0, 1))
                de = dxs @ p[f"{side}w"].T
                demb += de if side == "f" else de[::-1]
            np.add.at(g["e"], x, demb)
            step += 1
            lr = rate * min(1.0, 3 * (1 - step / (total + 1)))
            for k2 in p:
                m[k2] = 0.9 * m[k2] + 0.1 * g[k2]
                s[k2] = 0.999 * s[k2] + 0.001 * g[k2] ** 2
                p[k2] -= lr * (m[k2] / (1 - 0.9**step)) / (np.sqrt(s[k2] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


class Network:
    """A trained network, ready to label texts."""

    def __init__(self, langs: list[str], params: dict):
        self.langs = langs
        self.sides = []
        for i, side in enumerate("fb" if params else ""):
            table = params["e"] @ params[f"{side}w"] + params[f"{side}b"]
            # the gates side by side, the candidate apart; its recurrent part is halved, as the reset gate is left at 0..2
            parts = lambda m, f: [np.ascontiguousarray(m[:, : 2 * HIDDEN]), np.ascontiguousarray(m[:, 2 * HIDDEN :] * np.float32(f))]
            self.sides.append((parts(table, 1), parts(params[f"{side}u"], 0.5), params["o"][i * HIDDEN : (i + 1) * HIDDEN]))
        self.bias = params.get("ob")

    def states(self, side: int, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """States (T, B, H) over bytes ``x`` (T, B) from the states ``h``."""
        (tg, tn), (ug, un), _ = self.sides[side]
        out = np.empty((*x.shape, HIDDEN), np.float32)
        gates, n = np.empty((len(h), 2 * HIDDEN), np.float32), np.empty_like(h)
        big, size = np.empty_like(gates), np.empty_like(h)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        for t in range(len(x)):
            np.matmul(h, ug, out=gates)
            gates += tg.take(x[t], 0)
            np.abs(gates, out=big)
            big += 1
            gates /= big
            gates += 1
            np.matmul(h, un, out=n)
            n *= r
            n += tn.take(x[t], 0)
            np.abs(n, out=size)
            size += 1
            n /= size
            h = np.subtract(h, n, out=out[t])
            h *= z
            h *= 0.5
            h += n
        return out

    def logits(self, side: int, raw: np.ndarray, before: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One direction's part of the logits at every place of ``raw``.

        Chunks ``start`` to ``end`` read from ``before`` on; ``first`` marks those that
        begin a text.  The reverse direction passes everything reversed.
        """
        weights = self.sides[side][2]
        out = np.empty((len(raw), weights.shape[1]), np.float32)
        padded = np.concatenate([raw, np.zeros(CHUNK + WARM, np.uint8)])
        warm, last = (np.zeros((len(start), HIDDEN), np.float32) for _ in range(2))

        def run(which: np.ndarray, begin: np.ndarray, h0: np.ndarray) -> None:
            sizes = end[which] - begin
            order = np.argsort(-sizes, kind="stable")
            for k in range(0, len(order), BATCH):
                at = order[k : k + BATCH]
                chunk, lo, n = which[at], begin[at], sizes[at]
                spare = -len(at) % PAD  # whole blocks of rows, so that a text's result doesn't hang on its company
                h = np.concatenate([h0[at], np.zeros((spare, HIDDEN), np.float32)])
                x = np.zeros((n[0], len(h)), np.uint8)
                x[:, : len(at)] = np.lib.stride_tricks.sliding_window_view(padded, n[0])[lo].T
                states = self.states(side, x, h)
                found = np.ascontiguousarray((states.reshape(-1, HIDDEN) @ weights).reshape(n[0], len(h), -1).transpose(1, 0, 2))
                early = start[chunk] - lo
                for i, (a, b, e) in enumerate(zip(start[chunk].tolist(), end[chunk].tolist(), early.tolist(), strict=True)):
                    out[a:b] = found[i, e : e + b - a]
                last[chunk] = states[n - 1, np.arange(len(at))]
                warmed = np.flatnonzero(early > 0)
                warm[chunk[warmed]] = states[early[warmed] - 1, warmed]

        every = np.arange(len(start))
        run(every, before, np.zeros((len(start), HIDDEN), np.float32))
        inner = every[~first]
        while len(inner):  # chunks that don't carry on from where their neighbour ended
            inner = inner[(np.abs(warm[inner] - last[inner - 1]) > TOLERANCE).any(1)]
            if len(inner):
                carried = last[inner - 1]
                warm[inner] = carried
                run(inner, start[inner], carried)
                inner = every[~first]
        return out

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        parts = [t.lower().encode("utf-8", "surrogatepass") if self.langs and has_letter(t) else b"" for t in texts]
        lengths = np.array([len(p) for p in parts], np.int64)
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        live = np.flatnonzero(lengths)
        if not len(live):
            return out
        raw = np.frombuffer(b"".join(parts), np.uint8)
        lengths = lengths[live]
        ends = np.cumsum(lengths)
        begins = ends - lengths
        chunks = -(-lengths // CHUNK)
        of = np.repeat(np.arange(len(live)), chunks)
        number = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = begins[of] + number * CHUNK
        end = np.minimum(start + CHUNK, ends[of])
        logits = self.logits(0, raw, np.maximum(start - WARM, begins[of]), start, end, number == 0)
        total = len(raw)
        back = self.logits(1, raw[::-1], (total - np.minimum(end + WARM, ends[of]))[::-1], (total - end)[::-1], (total - start)[::-1], (number == chunks[of] - 1)[::-1])
        logits += back[::-1]
        logits += self.bias
        np.clip(logits, -80, 80, out=logits)
        np.exp(logits, out=logits)
        logits /= logits @ np.ones((logits.shape[1], 1), np.float32)
        prob = np.round(np.add.reduceat(logits, begins, 0, np.float64) / lengths[:, None], 6)
        for i, row in zip(live, prob, strict=True):
            best = int(row.argmax())
            out[i] = (self.langs[best], float(min(1.0, row[best])))
        return out


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDY.finditer(text))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 160, seed: int = 11) -> tuple[list[str], dict]:
    """Learn from the rows that aren't held out: languages (sorted) and weights.

    ``per_lang`` bounds the documents of each language: those with the smallest hashes
    of their ids and texts, out of all rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(~held_out("id") & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return [], {}
    per_lang = max(1, min(per_lang, MAX_DOCS // len(langs)))
    hashed = rows.withColumn("h", F.xxhash64("id", "text", F.lit(seed)))
    draw = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, 1.3 * per_lang / sizes[k] + 20 / sizes[k])))])
    drawn = hashed.filter(draw < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))).select("lang", "h", "text")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("h", T.LongType()), T.StructField("windows", T.ArrayType(T.BinaryType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = []
            for h, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.lower().encode("utf-8", "surrogatepass")
                places = np.random.default_rng(h & 0xFFFFFFFF).integers(0, max(1, len(raw) - WINDOW + 1), min(PER_DOC, 1 + len(raw) // WINDOW))
                windows.append([raw[p : p + WINDOW] for p in places.tolist()] if raw else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(windows, pa.list_(pa.binary()))], names=schema.names)

    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    found = drawn.mapInArrow(cut, schema).withColumn("place", first).filter(F.col("place") <= per_lang).select("lang", "windows").collect()
    windows: list[bytes] = []
    labels: list[int] = []
    for lang, mine in sorted((r["lang"], [bytes(w) for w in r["windows"]]) for r in found):
        windows += mine
        labels += [langs.index(lang)] * len(mine)
    return (langs, train(windows, np.array(labels), len(langs))) if windows else ([], {})


def identify(docs: DataFrame, model: tuple[list[str], dict], keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` (default: ``doc_id``) with ``lang_pred`` and ``score`` of every document.  A map over the rows, without a shuffle."""
    small_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    named = [c for c in keep if c not in ("lang_pred", "score")]
    at = named.index(text_col) if text_col in named else len(named)
    source = docs.select(*[F.col(c) for c in named], *[text_of(text_col).alias("__text")] * (at == len(named)))
    out = T.StructType([*source.schema.fields[: len(named)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(*model)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in slices(texts, 500_000):
                found = network(texts[a:b])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(named)]), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=out.names)
        trim()

    return source.mapInArrow(run, out)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """Query: predicted language of every document."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
