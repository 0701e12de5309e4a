"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation
through time. The network reads a text word by word (lower-cased, a space on either side, long words in overlapping windows), labels every
byte position, and the document's probabilities are the mean over all positions. Since a word's labels depend on the word
alone, a task computes them once for each distinct word it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, place_of, small, stage, unpacked

#: Hidden units of each direction; bytes of a window of a word, and of these on either side those that only another window labels; documents of each language and words of each document learned from.
#: Characters of a word that are learned from, at most; labelling reads all of them.
LEARNT_CHARS = 64
HIDDEN, PIECE, MARGIN, SAMPLE_DOCS, SAMPLE_WORDS = 16, 24, 6, 300, 40
#: A text is of no language if that is more probable than each language by SLACK / sqrt(byte positions): short texts need more.
SLACK = 3.0
#: Words whose labels a task keeps, and characters of the documents that it labels together.
KEPT_WORDS, GROUP_CHARS = 250_000, 2 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """params: per direction a table of byte inputs (256 x 3H, bias included) and recurrent weights (H x 3H); then the output layer."""

    def __init__(self, labels: int, hidden: int = HIDDEN, seed: int = 3):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {k: (rng.normal(0, s, shape)).astype(np.float32) for k, s, shape in (("xf", 0.3, (256, 3 * h)), ("uf", h**-0.5, (h, 3 * h)), ("xb", 0.3, (256, 3 * h)), ("ub", h**-0.5, (h, 3 * h)), ("w", 0.3, (2 * h, labels)), ("b", 0.0, (labels,)))}

    def _run(self, ids: np.ndarray, x: np.ndarray, u: np.ndarray, keep: bool):
        h, (n, t) = self.h, ids.shape
        state, out, tape = np.zeros((n, h), np.float32), np.empty((t, n, h), np.float32), []
        for i in range(t):
            a, r_in = x[ids[:, i]], state @ u
            zr = _sigmoid(a[:, : 2 * h] + r_in[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h :] + r * r_in[:, 2 * h :])
            new = c + z * (state - c)
            if keep:
                tape.append((state, z, r, c, r_in[:, 2 * h :]))
            state = out[i] = new
        return out, tape

    def forward(self, ids: np.ndarray, keep: bool = False):
        """ids: bytes of equally long pieces (n x t) -> probabilities (n x t x labels)."""
        p = self.p
        f, tf = self._run(ids, p["xf"], p["uf"], keep)
        b, tb = self._run(ids[:, ::-1], p["xb"], p["ub"], keep)
        both = np.concatenate([f, b[::-1]], 2)  # t x n x 2h
        y = both @ p["w"] + p["b"]
        y = np.exp(y - y.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        return y.transpose(1, 0, 2), (both, tf, tb)

    def _back(self, ids: np.ndarray, d: np.ndarray, tape: list, u: np.ndarray, gx: np.ndarray, gu: np.ndarray) -> None:
        h, carried = self.h, 0.0
        for i in range(len(tape) - 1, -1, -1):
            state, z, r, c, rec = tape[i]
            dn = d[i] + carried
            dz, dc = dn * (state - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
            dr = dc * rec * r * (1 - r)
            inner = np.concatenate([dz, dr, dc * r], 1)
            np.add.at(gx, ids[:, i], np.concatenate([dz, dr, dc], 1))
            gu += state.T @ inner
            carried = dn * z + inner @ u.T

    def gradients(self, ids: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, through time in both directions."""
        y, (both, tf, tb) = self.forward(ids, keep=True)
        n, t, _ = y.shape
        loss = -float(np.log(np.maximum(y[np.arange(n), :, label], 1e-9)).mean())
        dy = y.copy()
        dy[np.arange(n), :, label] -= 1
        dy = dy.transpose(1, 0, 2) / (n * t)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["w"], g["b"] = np.einsum("tnh,tnl->hl", both, dy), dy.sum((0, 1))
        d = dy @ self.p["w"].T
        self._back(ids, d[:, :, : self.h], tf, self.p["uf"], g["xf"], g["uf"])
        self._back(ids[:, ::-1], d[::-1, :, self.h :], tb, self.p["ub"], g["xb"], g["ub"])
        return loss, g

    def train(self, pieces: list[bytes], labels: np.ndarray, epochs: int = 4, batch: int = 512, rate: float = 0.01) -> list[float]:
        """Adam over batches of equally long pieces; returns the mean loss of each epoch."""
        rng, losses, step = np.random.default_rng(4), [], 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        length = np.array([len(x) for x in pieces])
        groups = {n: np.flatnonzero(length == n) for n in np.unique(length)}
        arrays = {n: np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(len(at), n) for n, at in groups.items()}
        for epoch in range(epochs):
            deals, total = [], []
            for n, at in groups.items():
                order = rng.permutation(len(at))
                deals += [(n, order[i : i + batch]) for i in range(0, len(order), batch)]
            for j in rng.permutation(len(deals)):
                n, pick = deals[j]
                loss, g = self.gradients(arrays[n][pick], labels[groups[n][pick]])
                total.append(loss)
                step += 1
                lr = rate * 0.5 ** (epoch / 2) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for k, x in g.items():
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.001 * (x * x - v[k])
                    self.p[k] -= lr * m[k] / (np.sqrt(v[k]) + 1e-8)
            losses.append(float(np.mean(total)))
        return losses


def pieces_of(word: bytes) -> list[tuple[bytes, int, int]]:
    """(window, from, to) of a word between spaces: its windows, and the positions that each labels, so that all together label every one once."""
    whole = b" " + word + b" "
    if len(word) <= PIECE:
        return [(whole, 0, len(whole))]
    step, out = PIECE - 2 * MARGIN, []
    for at in range(0, len(whole), step):
        start, end = max(0, at - MARGIN), min(len(whole), at + step + MARGIN)
        out.append((whole[start:end], at - start, min(at + step, len(whole)) - start))
    return out


class Labeller:
    """Sums of position probabilities by word, kept up to a bound."""

    def __init__(self, net: BiGRU, labels: list[str], noise: bool = False):
        """noise: the last label stands for no language."""
        self.net, self.labels, self.noise, self.at = net, labels, noise, {}
        self.sums = np.zeros((0, len(labels) + 1), np.float32)

    def learn(self, words: set[bytes]) -> None:
        if len(self.at) > KEPT_WORDS:
            self.at, self.sums = {}, self.sums[:0]
        new = [w for w in words if w not in self.at]
        sums = np.zeros((len(new), len(self.labels) + 1), np.float32)
        by_length: dict[tuple[int, int, int], tuple[list[int], list[bytes]]] = {}
        for i, w in enumerate(new):
            for p, a, b in pieces_of(w):
                own = by_length.setdefault((len(p), a, b), ([], []))
                own[0].append(i)
                own[1].append(p)
        for (n, a, b), (owner, pieces) in by_length.items():
            for s in range(0, len(pieces), 4096):
                y, _ = self.net.forward(np.frombuffer(b"".join(pieces[s : s + 4096]), np.uint8).reshape(-1, n))
                np.add.at(sums[:, :-1], owner[s : s + 4096], y[:, a:b].sum(1))
                np.add.at(sums[:, -1], owner[s : s + 4096], b - a)
        self.at.update(zip(new, range(len(self.sums), len(self.sums) + len(new)), strict=True))
        self.sums = np.concatenate([self.sums, sums])

    def documents(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Mean probabilities over all positions of each text, None without a letter; the words of all texts are learned together."""
        words = [t.lower().encode().split() if t and any(map(str.isalpha, t)) else None for t in texts]
        self.learn({w for own in words if own for w in own})
        out = []
        for own in words:
            if own:
                total = self.sums[np.fromiter(map(self.at.__getitem__, own), np.int64)].sum(0, dtype=np.float64)
                y = total[:-1] / total[-1]
                if self.noise:
                    y[-1] -= SLACK / np.sqrt(total[-1])
                out.append(y)
            else:
                out.append(None)
        return out

    def positions(self, text: str) -> list[str]:
        """The label of every byte of every word, in order."""
        out = []
        for w in text.lower().encode().split():
            own = []
            for p, a, b in pieces_of(w):
                own += [self.labels[i] for i in self.net.forward(np.frombuffer(p, np.uint8)[None])[0][0][a:b].argmax(1)]
            out += own[1:-1]
        return out


def noise_of(word: str, rng: np.random.Generator) -> str:
    """A word of no language: the letters of word in another order, random Latin letters, or letters of some other script."""
    kind = rng.integers(3)
    if kind == 0:
        return "".join(rng.permutation(list(word)))
    if kind == 1:
        return "".join(map(chr, rng.integers(97, 123, len(word))))
    while True:
        base = int(rng.integers(0x250, 0xD800 - 64))
        letters = [c for c in map(chr, range(base, base + 64)) if c.isalpha()]
        if letters:
            return "".join(rng.choice(letters, len(word)))


def fit(docs: DataFrame, folds: int = 5, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, noise: bool = False) -> Labeller:
    """Learns from text and lang of at most sample_docs documents of each language (those of the smallest hashes among
    the rows with a lang whose crc32(doc_id as text) mod folds is not 0; rows equal in lang, doc_id and text are one), and of these at
    most sample_words words each, of a longer word the first LEARNT_CHARS characters; so the sample's size is bounded. With noise the last label is `und`, learned from as many words of no language as a language has on average."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    own = F.xxhash64("text").alias("own")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc % folds != 0)).select(F.col("lang").alias("lang"), F.col("doc_id").alias("doc_id"), own, F.col("text").alias("text"))
    order = [F.xxhash64("doc_id"), "doc_id", "own"]
    # a task's smallest of each language, then of these the smallest of groups of tasks, then of all: the last ranks 16 times the sample of a language at most
    picked = known.select("lang", "doc_id", "own", F.spark_partition_id().alias("part"))
    for part in ("part", F.pmod("part", F.lit(1024)), F.pmod("part", F.lit(16)), F.lit(0)):
        keys = Window.partitionBy("lang", part)
        picked = picked.withColumn("rank", F.dense_rank().over(keys.orderBy(*order))).where(F.col("rank") <= sample_docs)
        picked = picked.groupBy("lang", "doc_id", "own").agg(F.min("part").alias("part"))
    picked = small(stage(picked.select("lang", "doc_id", "own"), "picked"), F.length("lang"))  # the sample
    parts = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    drawn = F.transform(F.array_distinct(F.array_remove(parts, "")), lambda w: F.struct(F.xxhash64("own", w).alias("h"), F.left(w, F.lit(LEARNT_CHARS)).alias("w")))
    some = F.slice(F.array_sort(drawn), 1, sample_words).getField("w")  # by hash: the same words in every run
    same = known.doc_id.eqNullSafe(picked.doc_id) & (known.lang == picked.lang) & (known.own == picked.own)
    rows = known.join(picked, same, "left_semi").dropDuplicates(["lang", "doc_id", "own"]).select("lang", "doc_id", F.array_sort(some).alias("w")).collect()  # bounded by the sample
    labels = sorted({r["lang"] for r in rows})
    languages, rng = len(labels), np.random.default_rng(6)
    if noise and labels:
        labels = [*labels, "und"]
    net = BiGRU(max(1, len(labels)))
    pieces, target = [], []
    for r in sorted(rows, key=lambda r: (r["lang"], str(r["doc_id"]), r["w"])):
        for w in r["w"]:
            own = [p for p, _, _ in pieces_of(w.encode())]
            pieces += own
            target += [labels.index(r["lang"])] * len(own)
            if noise and rng.random() * languages < 1:
                own = [p for p, _, _ in pieces_of(noise_of(w, rng).encode())]
                pieces += own
                target += [languages] * len(own)
    if len(labels) > 1:
        net.train(pieces, np.array(target))
    return Labeller(net, labels, noise and bool(labels))


def _predictor(params: dict[str, np.ndarray], labels: list[str], hidden: int, noise: bool, place: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = BiGRU(max(1, len(labels)), hidden)
        net.p = params
        labeller = Labeller(net, labels, noise)
        for batch in batches:
            texts, lang, score, at = batch.column(0).field(place).to_pylist(), [], [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= GROUP_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                for y in labeller.documents(texts[at:end]) if labels else [None] * (end - at):
                    lang.append("und" if y is None else labels[int(y.argmax())])
                    score.append(0.0 if y is None else min(1.0, round(float(y.max()), 6)))
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    return predict


def _labelled(docs: DataFrame, model: Labeller) -> DataFrame:
    rows = packed(docs)
    schema = packed(docs).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(_predictor(model.net.p, model.labels, model.net.h, model.noise, place_of(docs, "text")), schema)


def label(docs: DataFrame, model: Labeller) -> DataFrame:
    """docs with what the model says of text; identify() has the defined results."""
    return unpacked(_labelled(docs, model), "lang_pred", "score")


def identify(docs: DataFrame, learn_from: DataFrame | None = None, folds: int = 5) -> DataFrame:
    """docs with lang_pred (a learned lang value; `und` if the text is null or has no letter) and score (0 to 1; 0 for und).

    Only the text decides. Rows with one text are answered alike. If no row can be learned from, all are und. Columns with
    the names of the results, in whatever case, are replaced. An empty table gives an empty result.
    """
    return label(docs, fit(learn_from if learn_from is not None else docs, folds))


def reject(docs: DataFrame, lift: float | None = None) -> DataFrame:
    """docs without those that are und: without a letter, or of no language by a network that also learns words of none.

    What is told apart is text from random letters, from other scripts and mostly from languages that were not learned; words with
    their letters in another order are told apart only in part. The longer a text, the less it takes (SLACK), so short clean texts
    stay. With a lift there are no words of none: those go that are less probable than `lift` times chance (1 / number of
    languages). Columns as given. Without a language to learn all texts are und.
    """
    model = fit(docs, noise=lift is None)
    found = _labelled(docs, model).where("lang_pred <> 'und'")
    if lift is not None:
        found = found.where(F.col("score") >= min(1.0, lift / max(1, len(model.labels))))
    return unpacked(found)
