"""Brown class-based bigram model: P(w | v) = P(class(w) | class(v)) * P(w | class(w)).

Texts are read once, into chunks: the chunk's words and its texts as places among them. All later steps read chunks, so each
meets its own slice of the vocabulary and no task or driver needs all of it. Exchange clustering has two steps. In the
first the most frequent words move one by one, and all others in groups by their last three bytes, so that a bounded table
of pairs tells every gain. In the second every other word moves by itself: its counts of classes before and after it, over
all training texts, tell the class that raises the likelihood most.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER_AZ, stage

#: Words that move one by one in the first step, groups of the other words there, and classes (the last is that of the text's end).
HEAD, GROUPS, CLASSES = 768, 255, 64
BLOCK_BYTES = 8 << 20
#: Places of a chunk that are looked at together, and texts that leave their batch together: what numpy and Python widen is no more than these.
SLICE, TEXTS = 1 << 18, 256
#: Bytes of text in a shuffle partition beyond the session's number of them.
PARTITION_BYTES = 256 << 20
#: Added to a word's count within its class, and weight of the class frequencies in the transitions.
ADDED, PRIOR = 0.5, 50.0
END = b""


def group_of(word: bytes) -> int:
    """The item that a word outside the head belongs to in the first step, told by its ending."""
    return HEAD + zlib.crc32(word[-3:]) % GROUPS


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*text.translate(LOWER_AZ).split(), END] if text else [END]


class Places(dict):
    """Words to their places, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes | None, bool]]:
    """(text, held_out) of a batch's rows."""
    for at in range(0, batch.num_rows, TEXTS):
        part = batch.slice(at, TEXTS)
        yield from zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True)


def _encode(block_bytes: int, id_type: pa.DataType):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text, held_out) -> (chunk, words, ids, doc_id, held_out): the words of a chunk joined by spaces, and its
        texts as places among them; place 0 is the end, which closes every text. Places are stored byte plane by byte plane."""
        chunk = TaskContext.get().partitionId() << 33
        place, rows, ids, held, size = Places({END: 0}), [], [], [], 0

        def out():
            planes = np.concatenate(rows).view(np.uint8).reshape(-1, 4).T.tobytes()
            docs = pa.concat_arrays(ids)
            docs = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
            fields = [pa.array([chunk]), pa.array([b" ".join(list(place)[1:])], pa.binary()), pa.array([planes], pa.binary()), docs, pa.array([bytes(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(fields, ["chunk", "words", "ids", "doc_id", "held_out"])

        for batch in batches:
            start = 0
            for i, (text, left_out) in enumerate(_texts(batch)):
                tokens = tokens_of(text)
                rows.append(np.fromiter(map(place.__getitem__, tokens), np.uint32, len(tokens)))
                held.append(left_out)
                size += len(text or b"") + 16
                if size >= block_bytes:
                    ids.append(batch.column(0).slice(start, i + 1 - start).cast(id_type))
                    yield out()
                    start, chunk = i + 1, chunk + 1
                    place, rows, ids, held, size = Places({END: 0}), [], [], [], 0
            if start < batch.num_rows:
                ids.append(batch.column(0).slice(start).cast(id_type))
        if rows:
            yield out()

    return encode


def _places(planes: pa.Buffer) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def _slices(n: int) -> Iterator[slice]:
    return (slice(at, min(at + SLICE, n)) for at in range(0, n, SLICE))


def _taken(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x[at]; of the places only a slice at a time is widened."""
    out = np.empty(len(at), x.dtype)
    for s in _slices(len(at)):
        out[s] = x[at[s]]
    return out


def _counted(at: np.ndarray, size: int) -> np.ndarray:
    """How often each of size numbers stands in at."""
    total = np.zeros(size, np.int64)
    for s in _slices(len(at)):
        total += np.bincount(at[s], minlength=size)
    return total


def _decode(words: bytes, planes: pa.Buffer, held_out: pa.Buffer) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of a chunk, its places, and which of these stand in training texts."""
    ids = _places(planes)
    lengths = np.diff(np.flatnonzero(ids == 0), prepend=-1)
    return [END, *words.split(b" ")] if words else [END], ids, np.repeat(np.frombuffer(held_out, np.uint8) == 0, lengths)


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(chunk, words, places, training or not) of each chunk in batches that have these columns first."""
    for batch in batches:
        for i in range(batch.num_rows):
            chunk, words, ids, held = (batch.column(k)[i] for k in range(4))
            yield chunk.as_py(), *_decode(words.as_py(), ids.as_buffer(), held.as_buffer())


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks -> (word, c): counts in training texts."""
    for _, words, ids, train in _chunks(batches):
        c = _counted(ids[train], len(words))
        c[0] = 0
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).take(pa.array(at)), pa.array(c[at])], ["word", "c"])


def _pairs(head: dict[bytes, int]):
    size = HEAD + GROUPS + 1

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks -> (pair, n): counts of adjacent items in training texts, a text's start being an end."""
        total = np.zeros(size * size, np.int64)
        for _, words, ids, train in _chunks(batches):
            item = np.array([size - 1, *(head[w] if w in head else group_of(w) for w in words[1:])], np.int32)
            a = _taken(item, ids[train])
            pair = np.concatenate([item[:1], a[:-1]])[: len(a)]
            pair *= size
            pair += a
            for s in _slices(len(pair)):
                total += np.bincount(pair[s], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return pairs


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = 8) -> np.ndarray:
    """Class of each item by exchange: every item in turn moves to the class that raises the class bigram likelihood most.
    The most frequent items start with a class each and the rest outside all classes, from where the first sweep takes them
    (a start with evenly mixed classes is a saddle that no single move leaves). The last item (the end) keeps the last class."""
    c = counts.astype(np.float64)
    size, f = len(c), lambda x: x * np.log(np.maximum(x, 1.0))
    weight = c.sum(0) + c.sum(1)
    order = np.argsort(-weight[:-1], kind="stable")
    cls = np.full(size, classes, np.int64)
    cls[order[: classes - 1]], cls[-1] = np.arange(min(size, classes) - 1), classes - 1
    one = np.eye(classes + 1)[cls]
    right, left = c @ one, c.T @ one  # by item: into which classes, from which classes
    g = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if weight[w] == 0:
                continue
            a, s = cls[w], c[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= s
            l[a] -= s
            g[a] -= r
            g[:, a] -= l
            g[a, a] -= s
            rows, cols = g.sum(1) + l, g.sum(0) + r  # what stands before and after w counts wherever w goes
            fg = f(g)
            gain = (f(g + r) - fg).sum(1) + (f(g + l[:, None]) - fg).sum(0)
            d = np.diag(g)
            gain += f(d + r + l + s) - f(d + r) - f(d + l) + f(d)
            gain -= f(rows + r.sum() + s) - f(rows) + f(cols + l.sum() + s) - f(cols)
            gain[-2:] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-6:
                b = a
            g[b] += r
            g[:, b] += l
            g[b, b] += s
            if b != a:
                right[:, a] -= c[:, w]
                right[:, b] += c[:, w]
                left[:, a] -= c[w]
                left[:, b] += c[w]
                cls[w], moved = b, moved + 1
        if not moved:
            break
    return np.where(cls == classes, 0, cls)


def first_classes(words: list[bytes], head: dict[bytes, int], cls: np.ndarray) -> np.ndarray:
    """Classes of a chunk's words (the end first) after the first step."""
    return np.array([cls[-1], *(cls[head[w] if w in head else group_of(w)] for w in words[1:])], np.int64)


def _neighbours(head: dict[bytes, int], cls: np.ndarray):
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks -> (word, seen, chunk, place): for words outside the head, bytes in twos: a class before the word, or CLASSES
        more for one after it, and how often in training texts (in parts of at most 255; empty for words of the others alone)."""
        for chunk, words, ids, train in _chunks(batches):
            w, outside = ids[train], np.array([False, *(x not in head for x in words[1:])])
            del ids, train
            kind = np.int32 if len(words) < 1 << 24 else np.int64  # keys below 2 ** 31 take half the memory
            k = _taken(first_classes(words, head, cls).astype(np.uint8), w)  # the text before a text, and the one after all, end with the end's class
            tail = np.flatnonzero(_taken(outside, w)).astype(np.int32)
            key, end = np.empty(2 * len(tail), kind), np.uint8(cls[-1])
            for s in _slices(len(tail)):
                at = tail[s]
                base = w[at].astype(kind) * kind(2 * CLASSES)
                key[2 * s.start : 2 * s.stop : 2] = base + np.where(at > 0, k[at - 1], end)
                key[2 * s.start + 1 : 2 * s.stop : 2] = base + kind(CLASSES) + np.where(at + 1 < len(k), k[np.minimum(at + 1, len(k) - 1)], end)
            del w, k, tail
            key.sort()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)]).astype(np.int32)
            n, key = np.diff(starts, append=np.int32(len(key))), key[starts]
            parts = (n + np.int32(254)) // np.int32(255)
            last = np.cumsum(parts) - 1
            own, key = np.flatnonzero(outside), np.repeat(key, parts)
            start = np.searchsorted(key, (own * (2 * CLASSES)).astype(kind))
            seen = np.empty((len(key), 2), np.uint8)
            seen[:, 0], seen[:, 1] = key % kind(2 * CLASSES), 255
            seen[last, 1] = n - 255 * (parts - 1)
            ends = np.append(start, len(key)).astype(np.int32) * 2
            seen = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(seen)])
            del key, starts, n, parts, last
            fields = [pa.array(words, pa.binary()).take(pa.array(own)), seen, pa.array(np.full(len(own), chunk)), pa.array(own.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(fields, ["word", "seen", "chunk", "place"])

    return neighbours


def best_classes(seen: np.ndarray, now: np.ndarray, by_class: np.ndarray) -> np.ndarray:
    """The second step, all other words staying: for each row of `seen` (counts of classes before, then after) the class that
    raises the class bigram likelihood most, by its slope; without the word itself in the class it is in `now`."""
    c, log = seen[:, :CLASSES].sum(1), lambda x: np.log(x + 1.0)
    flow = log(by_class.sum(0)) + log(by_class.sum(1))
    gain = seen @ np.concatenate([log(by_class), log(by_class.T)]) - c[:, None] * flow
    before, after = by_class[:, now].T - seen[:, :CLASSES], by_class[now] - seen[:, CLASSES:]
    stay = (seen[:, :CLASSES] * log(before.clip(0))).sum(1) + (seen[:, CLASSES:] * log(after.clip(0))).sum(1)
    stay -= c * (log((by_class.sum(0)[now] - c).clip(0)) + log((by_class.sum(1)[now] - c).clip(0)))
    gain[np.arange(len(now)), now] = stay + 1e-6
    gain[:, -1] = -np.inf
    return np.argmax(gain.round(6), 1)


#: A known word of a chunk; `cls` is FIRST more in one of the chunks that hold the word. Stored byte plane by byte plane.
KNOWN, FIRST = np.dtype([("place", "<u4"), ("c", "<i8"), ("cls", "u1")]), 128


def _pack(known: np.ndarray) -> bytes:
    return known.view(np.uint8).reshape(-1, KNOWN.itemsize).T.tobytes()


def _unpack(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(KNOWN.itemsize, -1).T.copy().view(KNOWN).ravel()


def _move(cls: np.ndarray, by_class: np.ndarray, at_once: int = 500_000):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, seen, chunk, place) in order of words -> (chunk, known): each word's count and new class for every chunk that
        holds it. Of a word's rows the sum and the places are held, 12 bytes for each chunk with it."""
        word, held, places = None, np.zeros(2 * CLASSES), []
        chunks, knowns, n = [], [], 0

        def add(words, sums, group, chunk, place):
            nonlocal n
            new = best_classes(sums, np.array([cls[group_of(w)] for w in words], np.int64), by_class)
            known = np.zeros(len(group), KNOWN)
            known["place"], known["c"], known["cls"] = place, sums[:, :CLASSES].sum(1)[group], new[group]
            known["cls"][np.unique(group, return_index=True)[1]] += FIRST
            learned = known["c"] > 0
            chunks.append(chunk[learned])
            knowns.append(known[learned])
            n += learned.sum()

        def held_places():
            return (np.concatenate(x) for x in zip(*places, strict=True))

        def out():
            nonlocal n
            chunk, known = np.concatenate(chunks), np.concatenate(knowns)
            order = np.lexsort((known["place"], chunk))
            own, start = np.unique(chunk[order], return_index=True)
            fields = [pa.array(own), pa.array([_pack(x) for x in np.split(known[order], start[1:])], pa.binary())]
            chunks.clear()
            knowns.clear()
            n = 0
            return pa.RecordBatch.from_arrays(fields, ["chunk", "known"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words, parts, chunk, place = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            new = np.append(True, pc.not_equal(batch.column(0).slice(1), batch.column(0).slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)).astype(bool)
            group = np.cumsum(new) - 1
            codes = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 2)
            row = np.repeat(group, [len(p) // 2 for p in parts])
            sums = np.bincount(row * (2 * CLASSES) + codes[:, 0], codes[:, 1], (group[-1] + 1) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
            kinds = [words[i] for i in np.flatnonzero(new)]
            if kinds[0] == word:
                sums[0] += held
            elif word is not None:
                at, where = held_places()
                add([word], held[None], np.zeros(len(at), np.int64), at, where)
                places = []
            last = group == group[-1]
            if len(kinds) > 1:
                places.append((chunk[~last], place[~last]))
                at, where = held_places()
                add(kinds[:-1], sums[:-1], np.append(np.zeros(len(at) - (~last).sum(), np.int64), group[~last]), at, where)
                places = []
            places.append((chunk[last], place[last]))
            word, held = kinds[-1], sums[-1].copy()
            if n >= at_once:
                yield out()
        if word is not None:
            at, where = held_places()
            add([word], held[None], np.zeros(len(at), np.int64), at, where)
        if n:
            yield out()

    return move


def _light(head: dict[bytes, int], cls: np.ndarray, head_counts: np.ndarray, ends: int):
    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with a class for each word in place of the words, and what is known of the head and the end."""
        for batch in batches:
            first, known = [], []
            for i in range(batch.num_rows):
                words = batch.column("words")[i].as_py()
                words = [END, *words.split(b" ")] if words else [END]
                first.append(first_classes(words, head, cls).astype(np.uint8).tobytes())
                known.append(_pack(np.array([(0, ends, cls[-1]), *((p, head_counts[head[w]], cls[head[w]]) for p, w in enumerate(words) if w in head)], KNOWN)))
            fields = [*(batch.column(k) for k in ("chunk", "ids", "doc_id", "held_out")), pa.array(first, pa.binary()), pa.array(known, pa.binary())]
            yield pa.RecordBatch.from_arrays(fields, ["chunk", "ids", "doc_id", "held_out", "first", "known"])

    return light


def _paths(id_type: pa.DataType):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "log_base", "log_own", "path", "kinds"]
    types = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]

    def paths(chunk: pa.Table, known: pa.Table) -> pa.Table:
        """A chunk and its known words -> its texts' classes, and sums that need neither transitions nor totals. The first text
        carries the number of words by class that have this chunk as their first."""
        out = []
        for i in range(chunk.num_rows):
            ids, held_out = _places(chunk.column("ids")[i].as_buffer()), np.frombuffer(chunk.column("held_out")[i].as_py(), np.uint8) != 0
            k, kinds = np.frombuffer(chunk.column("first")[i].as_py(), np.uint8).copy(), np.zeros(CLASSES, np.int32)
            c = np.zeros(len(k))
            for planes in (chunk.column("known")[i].as_py(), *known.column("known").to_pylist()):
                found = _unpack(planes)
                c[found["place"]], k[found["place"]] = found["c"], found["cls"] % FIRST
                kinds += np.bincount(found["cls"][found["cls"] >= FIRST] % FIRST, minlength=CLASSES).astype(np.int32)
            ends = np.flatnonzero(ids == 0) + 1
            starts = np.append(0, ends[:-1])
            path = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(_taken(k, ids))])
            sums = [np.add.reduceat(_taken(x, ids), starts) for x in ((c > 0).astype(np.int64), np.log10(c + 1), np.log10(c + ADDED))]
            doc_ids = chunk.column("doc_id").combine_chunks().slice(i, 1).flatten().cast(id_type)
            fields = [doc_ids, pa.array(held_out), pa.array(ends - starts), *map(pa.array, sums), path, pa.array([kinds.tobytes(), *[None] * (len(ends) - 1)], pa.binary())]
            out.append(pa.Table.from_arrays(fields, names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in types], names)

    return paths


def _steps(paths: pa.Array) -> np.ndarray:
    """Pairs of adjacent classes of texts, one by one; every text ends with the end's class and starts after it."""
    k = np.frombuffer(b"".join(paths.to_pylist()), np.uint8).astype(np.int64)
    return np.append(CLASSES - 1, k[:-1])[: len(k)] * CLASSES + k


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(held_out, path, kinds) -> (at, n): training texts' pairs of adjacent classes, then words by class."""
    total = np.zeros(CLASSES * CLASSES + CLASSES, np.int64)
    for batch in batches:
        total[: CLASSES * CLASSES] += np.bincount(_steps(batch.column(1).filter(pc.invert(batch.column(0)))), minlength=CLASSES * CLASSES)
        for kinds in batch.column(2).drop_null().to_pylist():
            total[CLASSES * CLASSES :] += np.frombuffer(kinds, np.int32)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


def transitions(by_class: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), drawn to the class frequencies."""
    freq = (by_class.sum(0) + 1) / (by_class.sum() + CLASSES)
    return np.log10((by_class + PRIOR * freq) / (by_class.sum(1, keepdims=True) + PRIOR))


def totals(by_class: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 of what a word's count is divided by within its class, which has its words and one place for all unknown ones."""
    return np.log10(by_class.sum(0) + ADDED * (kinds + 1))


def _score(tokens: int, kinds: int, step: np.ndarray):
    """step: log10 P(class | class before), less the totals of the class."""
    flat, one = step.ravel(), math.log10(tokens + kinds + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, base, own = (batch.column(k).to_numpy() for k in (2, 4, 5))
            s = own + np.add.reduceat(flat[_steps(batch.column(6))], np.append(0, np.cumsum(n)[:-1]))
            fields = [*batch.columns[:4], *map(pa.array, (np.full(len(n), tokens), base - n * one, s, 10 ** np.minimum(300.0, -s / n)))]
            yield pa.RecordBatch.from_arrays(fields, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return score


def _summed(found: DataFrame, key: str, size: int) -> np.ndarray:
    """(key, n) summed up; at most size rows."""
    found, total = found.groupBy(key).agg(F.sum("n").alias("n")).toPandas(), np.zeros(size)
    total[found[key].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return total


def brown_scores(docs: DataFrame, folds: int = 7, held_out: int = 2, block_bytes: int = BLOCK_BYTES, head_words: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of docs.

    The model learns from the rows whose crc32(doc_id as text) mod folds is not held_out; a null doc_id counts as an empty
    one. Tokens: words between white space with A-Z lower-cased, then one end; a null or empty text is its end alone.
    base_score is an add-one unigram's, score the class bigram's log10 probability of the text, in which each class keeps
    one place for unknown words; an unknown word has the class of the first step's group for its ending. Of the training
    words the head_words most frequent (HEAD at most) move one by one in the first step, each other one in the second. Repeated rows are
    learned from and scored as often as they stand. Without training rows all counts are 0. Other columns are ignored; an
    empty table gives an empty result.
    """
    if not 0 < head_words <= HEAD:
        raise ValueError(f"head_words has to be from 1 to {HEAD}")
    spark, id_name = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", (crc % folds == held_out).alias("held_out"))
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    chunks = stage(rows.mapInArrow(_encode(block_bytes, id_type), f"chunk long, words binary, ids binary, doc_id array<{id_name}>, held_out binary"), "chunks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chunks.count() * block_bytes / PARTITION_BYTES))
    texts = chunks.select("chunk", "words", "ids", "held_out")
    found = texts.mapInArrow(_vocabulary, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    first = found.orderBy(F.desc("c"), "word").limit(head_words).collect()  # HEAD rows
    head = {bytes(r["word"]): i for i, r in enumerate(first)}
    items = HEAD + GROUPS + 1
    counts = _summed(texts.mapInArrow(_pairs(head), "pair long, n long"), "pair", items * items).reshape(items, items)  # at most 2 ** 20 rows
    cls, ends = exchange(counts), int(counts[:, -1].sum())
    one = np.eye(CLASSES)[cls]
    seen = texts.mapInArrow(_neighbours(head, cls), "word binary, seen binary, chunk long, place int").repartition(parts, "word").sortWithinPartitions("word")
    known = seen.mapInArrow(_move(cls, one.T @ counts @ one), "chunk long, known binary").repartition(parts, "chunk")
    light = chunks.mapInArrow(_light(head, cls, [r["c"] for r in first], ends), f"chunk long, ids binary, doc_id array<{id_name}>, held_out binary, first binary, known binary")
    schema = f"doc_id {id_name}, held_out boolean, n_tokens long, n_known long, log_base double, log_own double, path binary, kinds binary"
    both = light.repartition(parts, "chunk").groupBy("chunk").cogroup(known.groupBy("chunk"))
    paths = stage(both.applyInArrow(_paths(id_type), schema), "class-paths")
    at = _summed(paths.select("held_out", "path", "kinds").mapInArrow(_class_counts, "at long, n long"), "at", CLASSES * CLASSES + CLASSES)
    by_class, kinds = at[: CLASSES * CLASSES].reshape(CLASSES, CLASSES), at[CLASSES * CLASSES :] + np.bincount(cls[: len(head)], minlength=CLASSES)
    kinds[-1] += ends > 0
    step = transitions(by_class) - totals(by_class, kinds)
    schema = f"doc_id {id_name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return paths.mapInArrow(_score(int(by_class.sum()), int(kinds.sum()), step), schema)
