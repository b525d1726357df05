"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into segments; two recurrent layers read each segment, one from either end, and
every byte gets probabilities of the learned languages from both states there. The document's
probabilities are the means over all its bytes. Training is numpy backpropagation through time on the
driver, on a bounded draw of segments per language (`per_language` expected, from anywhere in its texts, by a hash of id and place); scoring reads
every byte of every text. Every non-null lang value is learned.

Null texts and texts without a letter are `und` with score 0; without a text to learn from, all are. lang, source
and ids are no inputs of a prediction. Repeated rows and null ids get rows like others (the fold of a null id is that of the empty text), and a
very long text is a batch by itself; an empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.folds import remainder
from massloom.llm.textcols import U64, chunks, mix, utf8


@dataclass(frozen=True)
class BiGRU:
    folds: int = 3
    held_out: int = 1
    hidden: int = 8
    segment: int = 64
    per_language: int = 2400
    epochs: int = 4
    batch: int = 64
    rate: float = 0.02


def segments(buf: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (n, width) padded by 0, the length and the row of each segment."""
    size = np.diff(bounds)
    per_row = -(-size // width)
    row = np.repeat(np.arange(len(size)), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = bounds[:-1][row] + nth * width
    length = np.minimum(width, bounds[1:][row] - start)
    inside = np.arange(width) < length[:, None]
    out = np.zeros((len(row), width), np.uint8)
    out[inside] = buf  # rows and their bytes are in order
    return out, length, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Per direction: gate inputs by byte (256, 2h) and (256, h), recurrent weights (h, 2h) and (h, h); then outputs (2h, c) and (c)."""

    def __init__(self, classes: list[str], hidden: int, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.classes, self.h = classes, hidden
        self.p = {}
        for d in "fb":
            self.p |= {f"{d}_xg": draw.normal(0, 0.3, (256, 2 * hidden)), f"{d}_xn": draw.normal(0, 0.5, (256, hidden)), f"{d}_hg": draw.normal(0, 0.3, (hidden, 2 * hidden)), f"{d}_hn": draw.normal(0, 0.3, (hidden, hidden))}
        self.p |= {"out": draw.normal(0, 0.3, (2 * hidden, len(classes))), "bias": np.zeros(len(classes))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, d: str, x: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
        """States (width, n, h) in the order of x's columns; live: which cells are no padding."""
        p, h, width = self.p, self.h, x.shape[1]
        gates_x, new_x, gates_h, new_h = (p[f"{d}_{k}"] for k in ("xg", "xn", "hg", "hn"))
        half = np.float32(0.5)
        gates_x, gates_h = gates_x * half, gates_h * half  # sigmoid by tanh of the half
        state = np.zeros((len(x), h), np.float32)
        out = np.empty((width, len(x), h), np.float32)
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            byte = x[:, t]
            gate = np.matmul(state, gates_h)
            gate += gates_x[byte]
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
            from_h = np.matmul(state, new_h)
            reset, update = gate[:, :h], gate[:, h:]
            new = reset * from_h
            new += new_x[byte]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, state, reset, update, new, from_h))
            state = state - new
            state *= update
            state += new
            if not live[:, t].all():
                state *= live[:, t, None]
            out[t] = state
        return out

    def probabilities(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sum over each segment's bytes of the class probabilities (n, c)."""
        live = (np.arange(x.shape[1]) < length[:, None]).astype(np.float32)
        both = (self._run("f", x, live, None), self._run("b", x, live, None))
        h, total = self.h, np.zeros((len(x), len(self.classes)), np.float32)
        for t in range(x.shape[1]):
            z = both[0][t] @ self.p["out"][:h]
            z += both[1][t] @ self.p["out"][h:]
            z += self.p["bias"]
            np.exp(z, out=z)
            z *= (live[:, t] / z.sum(axis=1))[:, None]
            total += z
        return total

    def gradients(self, x: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes, and its gradient by backpropagation through time."""
        p, h, live = self.p, self.h, (np.arange(x.shape[1]) < length[:, None]).astype(np.float32)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(d, x, live, kept[d]) for d in "fb"], axis=2)
        z = states @ p["out"] + p["bias"]
        z -= z.max(axis=2, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(axis=2, keepdims=True)
        n = live.sum()
        loss = float(-(np.log(prob[:, np.arange(len(x)), label] + 1e-9) * live.T).sum() / n)
        prob[:, np.arange(len(x)), label] -= 1
        dz = prob * (live.T / n)[:, :, None]
        g = {"out": np.einsum("tnh,tnc->hc", states, dz), "bias": dz.sum(axis=(0, 1))}
        dstates = dz @ p["out"].T
        for k, d in enumerate("fb"):
            own = dstates[:, :, k * h : (k + 1) * h]
            g |= {f"{d}_{n}": np.zeros_like(p[f"{d}_{n}"]) for n in ("xg", "xn", "hg", "hn")}
            back = np.zeros((len(x), h), np.float32)
            for t, before, reset, update, new, from_h in reversed(kept[d]):
                dh = (back + own[t]) * live[:, t, None]
                dnew = dh * (1 - update) * (1 - new * new)
                dgate = np.concatenate((dnew * from_h * reset * (1 - reset), dh * (before - new) * update * (1 - update)), axis=1)
                dfrom = dnew * reset
                np.add.at(g[f"{d}_xg"], x[:, t], dgate)
                np.add.at(g[f"{d}_xn"], x[:, t], dnew)
                g[f"{d}_hg"] += before.T @ dgate
                g[f"{d}_hn"] += before.T @ dfrom
                back = dh * update + dgate @ p[f"{d}_hg"].T + dfrom @ p[f"{d}_hn"].T
        return loss, g

    def fit(self, x: np.ndarray, length: np.ndarray, label: np.ndarray, how: BiGRU) -> None:
        draw = np.random.default_rng(1)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step, total = 0, how.epochs * -(-len(x) // how.batch)
        for _ in range(how.epochs):
            order = draw.permutation(len(x))
            for at in range(0, len(x), how.batch):
                own = order[at : at + how.batch]
                step += 1
                _, g = self.gradients(x[own], length[own], label[own])
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                rate = how.rate * (1 - step / (total + 1)) / (1 if norm < 1 else norm)
                for k, a in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a * a
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def train(docs: DataFrame, how: BiGRU = BiGRU()) -> Network | None:
    """docs: doc_id, text, lang."""
    width = how.segment
    known = docs.where(remainder("doc_id", how.folds) != how.held_out).where("lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / width)).alias("n")).where("n > 0")
    shares = counts.select(F.col("lang").alias("own"), F.least(F.lit(1.0), F.lit(float(how.per_language)) / F.col("n")).alias("share")).collect()  # a row per language
    if not shares:
        return None
    table = docs.sparkSession.createDataFrame(shares, "own string, share double")
    own = known.join(F.broadcast(table), F.col("lang") == F.col("own")).select("lang", "share", F.xxhash64("doc_id", F.lit(3)).alias("h"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x, length, row = segments(*utf8(b.column("text")), width)
            nth = (np.arange(len(row)) - np.searchsorted(row, row)).astype(U64)
            draw = mix(b.column("h").to_numpy().view(U64)[row] + mix(nth + U64(11))) >> U64(11)
            pick = np.flatnonzero(draw < (b.column("share").to_numpy()[row] * float(1 << 53)).astype(U64))
            data = [x[k, : length[k]].tobytes() for k in pick]
            yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(row[pick])), pa.array(data, pa.binary())], ["lang", "data"])

    got = own.mapInArrow(cut, "lang string, data binary").toArrow()
    classes = sorted(r["own"] for r in shares)
    data, lang = got.column("data").to_pylist(), got.column("lang").to_pylist()
    if not data:
        return None
    pairs = sorted(zip(data, lang))
    x = np.zeros((len(pairs), width), np.uint8)
    for k, (d, _) in enumerate(pairs):
        x[k, : len(d)] = np.frombuffer(d, np.uint8)
    net = Network(classes, how.hidden)
    net.fit(x, np.array([len(d) for d, _ in pairs]), np.array([classes.index(c) for _, c in pairs]), how)
    return net


def language(docs: DataFrame, how: BiGRU = BiGRU()) -> DataFrame:
    """doc_id, held_out, lang_pred, score (mean probability of that language over the text's bytes)."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, how))  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in chunks(batches):
            n = b.num_rows
            letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in b.column("text").to_pylist()])
            if net:
                buf, bounds = utf8(b.column("text"))
                x, length, row = segments(buf, bounds, how.segment)
                total, at = np.zeros((n, len(net.classes))), np.searchsorted(row, np.arange(n))
                if len(row):
                    some = np.flatnonzero(np.diff(bounds))
                    total[some] = np.add.reduceat(net.probabilities(x, length).astype(np.float64), at[some])
                mean = total / np.maximum(np.diff(bounds), 1)[:, None]
                best = mean.argmax(axis=1)
                names, score = np.array(net.classes, object)[best], mean[np.arange(n), best]
            else:
                names, score, letters = np.array(["und"] * n, object), np.zeros(n), np.zeros(n, bool)
            names[~letters], score = "und", np.where(letters, np.round(np.clip(score, 0, 1), 6), 0.0)  # the last bits depend on the batch
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", (remainder("doc_id", how.folds) == how.held_out).alias("held_out"), "lang_pred", "score")
