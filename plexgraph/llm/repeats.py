"""Finds windows of a fixed number of symbols that also start in a document of smaller doc_id; symbols are words or bytes.

Two identical windows have the same smallest k-gram hash at the same place, their anchor, so windows are compared only
within the group of their anchor. Documents are hashed to parts by doc_id, and three passes over the parts follow:

A  each part names the anchors it holds, packed to five bytes each; anchors of one document only go no further;
B  each part sends, for every run of windows with a shared anchor, the run's text once with the smallest and largest
   doc_id that has it there; groups find the smallest doc_id of every window and answer the parts;
C  each part marks what its documents' windows cover.

Equal runs collapse in their part before they travel, so a passage that a third of all documents share costs a
group one row a part, however many documents have it. An anchor with over ``HOT`` different runs is not grouped by
itself: its windows travel singly, grouped by a prefix of their own, the longer the fuller the anchor is, up to the whole
window (see :func:`prefix_length`). Runs count as equal only if their anchors, hashes and texts are. All data moves as
packed arrays; the text is shuffled once, compressed by part, and that exchange serves all passes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SOLID, from_planes, give_back, mix, partitions_for, planes, ranges, span_hashes, spans, text_bytes

#: Different runs of an anchor that make a group, and how many times as many lengthen the prefix once more.
HOT, FULLER, LEVELS = 4000, 16, 4
#: Bytes of text that a bucket solves at once, and windows that are anchored at once, in arrays that stay in a core's cache;
#: no effect on results.
SOLVED, STEP = 4 << 20, 1 << 15
_LAST = 2**63 - 1
_LOW = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Unit:
    """What a window is made of: ``length`` symbols, anchored at the least hash of its ``gram``-grams."""

    words: bool
    length: int
    gram: int


def prefix_length(unit: Unit, level: int) -> int:
    """Symbols of a window that name its group: the anchor's gram at level 0, the whole window at the last level."""
    return unit.gram + (unit.length - unit.gram) * level // LEVELS


def levels(runs: np.ndarray) -> np.ndarray:
    """The level of anchors with so many different runs."""
    full = np.maximum(runs, 1) / HOT
    return np.where(runs > HOT, np.clip(np.ceil(np.log(full) / np.log(FULLER)), 1, LEVELS), 0).astype(np.int64)


class Part:
    """The documents of a part as one array of symbols, with the runs of windows that share an anchor."""

    def __init__(self, table: pa.Table, unit: Unit):
        self.unit = unit
        self.ids = table.column("doc_id").fill_null(_LAST).to_numpy() if table.num_rows else np.zeros(0, np.int64)
        self.buf, self.off = text_bytes(table.column("text"))
        if unit.words:
            self.start, self.end, self.first = spans(self.buf, self.off, SOLID)
            self.symbols = span_hashes(self.buf, self.start, self.end)
        else:
            self.first, self.symbols = self.off, self.buf
        size = np.diff(self.first)
        self.at = ranges(self.first[:-1], np.maximum(0, size - unit.length + 1))  # window starts
        self.anchor, self.key = self._anchors()
        cut = np.flatnonzero((np.diff(self.at) != 1) | (np.diff(self.anchor) != 0)) + 1 if len(self.at) else np.zeros(0, np.int64)
        self.lo = np.r_[0, cut] if len(self.at) else cut  # runs as ranges of windows
        self.hi = np.r_[cut, len(self.at)] if len(self.at) else cut

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every window its anchor's place and 40-bit hash."""
        length, gram = self.unit.length, self.unit.gram
        width, n = length - gram + 1, len(self.symbols)
        anchor, key = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.uint64)
        for lo in range(0, n - length + 1, STEP):
            hi = min(lo + STEP, n - length + 1)
            a, b = np.searchsorted(self.at, (lo, hi))
            if a == b:
                continue
            have, done = self.symbols[lo : hi + length - 1].astype(np.uint64), 1
            if self.unit.words:
                have = mix(have + np.uint64(1))
            else:  # eight bytes fit a word as they are
                while done < 8:
                    have, done = have[:-done] << np.uint64(8 * done) | have[done:], 2 * done
            while done < gram:
                step = min(done, gram - done)
                have = mix(have[:-step] * np.uint64(0x9E3779B97F4A7C15) + have[step:])
                done += step
            g = (have & ~_LOW) | np.arange(len(have), dtype=np.uint64)
            done = 1
            while done < width:
                step = min(done, width - done)
                g = np.minimum(g[:-step], g[step:])
                done += step
            g = g[self.at[a:b] - lo]
            anchor[a:b] = lo + (g & _LOW).astype(np.int64)
            key[a:b] = g >> np.uint64(24)
        return anchor, key

    def split(self, hot: np.ndarray) -> np.ndarray:
        """Cuts the runs of hot anchors into single windows; gives which runs those are now."""
        run_hot = np.isin(self.key[self.lo], hot) if len(hot) else np.zeros(len(self.lo), bool)
        if run_hot.any():
            n = np.where(run_hot, self.hi - self.lo, 1)
            lo = np.repeat(self.lo, n) + np.where(np.repeat(run_hot, n), ranges(np.zeros(len(n), np.int64), n), 0)
            self.hi = np.where(np.repeat(run_hot, n), lo + 1, np.repeat(self.hi, n))
            self.lo = lo
            run_hot = np.repeat(run_hot, n)
        return run_hot

    def signatures(self, runs: np.ndarray | slice = slice(None)) -> np.ndarray:
        """A 64-bit hash of each run's text."""
        return span_hashes(self.symbols, self.at[self.lo[runs]], self.at[self.hi[runs] - 1] + self.unit.length)

    def documents(self, runs: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Each run's row."""
        return np.searchsorted(self.first, self.at[self.lo[runs]], "right") - 1

    def content(self, run: int) -> bytes:
        a, b = self.at[self.lo[run]], self.at[self.hi[run] - 1] + self.unit.length
        if self.unit.words:
            return b" ".join(self.buf[self.start[a] : self.end[b - 1]].tobytes().split())
        return self.buf[a:b].tobytes()


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzip(data: pa.Buffer) -> memoryview:
    return memoryview(pa.decompress(data[8:], int.from_bytes(data[:8].to_pybytes(), "little"), codec="zstd"))


def _pack_documents(batches):
    """Rows (p, data): the documents of a batch by part, compressed together; they are shuffled once and read by three passes."""
    for batch in batches:
        p = batch.column("p").to_numpy()
        order = np.argsort(p, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(p[order]) != 0, True]) if len(p) else np.zeros(1, np.int64)
        data = []
        for i, j in zip(at, at[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch.take(pa.array(order[i:j])))
            data.append(_zip(sink.getvalue()))
        yield pa.RecordBatch.from_arrays([pa.array(p[order[at[:-1]]], pa.int64()), pa.array(data, pa.binary())], ["p", "data"])
    give_back()


def _documents(packed: pa.Table) -> pa.Table:
    """What :func:`_pack_documents` packed."""
    if not packed.num_rows:
        return packed
    return pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(_unzip(x.as_buffer()))).read_all() for c in packed.column("data").chunks for x in c])


def _rows(bucket: np.ndarray, part: int, pack: Callable[[np.ndarray], tuple[int, bytes]]):
    """Rows (to, sender, n, data) of the members of each bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    at = np.r_[0, np.flatnonzero(np.diff(b)) + 1, len(b)] if len(b) else np.zeros(1, np.int64)
    got = [(int(b[i]), part, n, _zip(data)) for i, j in zip(at, at[1:]) for n, data in [pack(order[i:j])]]
    cols = list(zip(*got)) if got else [(), (), (), ()]
    return pa.table({"to": pa.array(cols[0], pa.int64()), "sender": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64()), "data": pa.array(cols[3], pa.binary())})


_SCHEMA = "to long, sender long, n long, data binary"


def _name_anchors(unit: Unit, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        part = Part(table, unit)
        key, sig, doc = part.key[part.lo], part.signatures(), part.ids[part.documents()]
        order = np.lexsort((sig, key))
        key, sig, doc = key[order], sig[order], doc[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        fresh = np.r_[True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])].astype(np.int64) if len(key) else np.zeros(0, np.int64)
        if len(at):
            runs = np.minimum(np.add.reduceat(fresh, at), (1 << 23) - 1)
            several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
            key = key[at]
        else:
            runs, several = np.zeros(0, np.int64), np.zeros(0, bool)
        note = (runs | several.astype(np.int64) << 23).astype(np.uint64)
        return _rows((key % np.uint64(buckets)).astype(np.int64), int(table.column("p")[0].as_py()), lambda k: (len(k), planes(key[k], 5) + planes(note[k], 3)))

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Answers each part with those of its anchors that two documents have, and their levels."""
    senders, ns, datas = table.column("sender").to_numpy(), table.column("n").to_numpy(), [_unzip(x.as_buffer()) for c in table.column("data").chunks for x in c]
    key = np.concatenate([from_planes(d, n, 5) for d, n in zip(datas, ns)])
    note = np.concatenate([from_planes(d[5 * n :], n, 3) for d, n in zip(datas, ns)]).astype(np.int64)
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    shared = (n > 1) | (np.bincount(at, note >> 23) > 0)
    hot = levels(np.bincount(at, note & ((1 << 23) - 1)))
    out, keep, hot, i = [], shared[at], hot[at], 0
    for sender, size in zip(senders, ns):
        k = np.flatnonzero(keep[i : i + size]) + i
        if len(k):
            out.append((int(sender), 0, len(k), _zip(planes(key[k], 5) + planes(hot[k].astype(np.uint64), 1))))
        i += size
    cols = list(zip(*out)) if out else [(), (), (), ()]
    return pa.table({"to": pa.array(cols[0], pa.int64()), "sender": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64()), "data": pa.array(cols[3], pa.binary())})


def _blobs(table: pa.Table):
    return zip([_unzip(x.as_buffer()) for c in table.column("data").chunks for x in c], table.column("n").to_pylist(), table.column("sender").to_pylist())


def _send_runs(unit: Unit, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _rows(np.zeros(0, np.int64), 0, None)
        part = Part(docs, unit)
        keys, marks = zip(*[(from_planes(d, n, 5), from_planes(d[5 * n :], n, 1)) for d, n, _ in _blobs(answers)])
        keys, marks = np.concatenate(keys), np.concatenate(marks).astype(np.int64)
        turn = np.argsort(keys)
        keys, marks = keys[turn], marks[turn]
        part.split(keys[marks > 0])
        runs = np.flatnonzero(np.isin(part.key[part.lo], keys))
        sig, doc, key = part.signatures(runs), part.ids[part.documents(runs)], part.key[part.lo[runs]]
        order = np.lexsort((sig, key))
        runs, sig, doc, key = runs[order], sig[order], doc[order], key[order]
        at = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]) if len(sig) else np.zeros(0, np.int64)
        if not len(at):
            return _rows(np.zeros(0, np.int64), 0, None)
        low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
        runs, sig = runs[at], sig[at]
        lo, hi = part.lo[runs], part.hi[runs]
        key = key[at]
        hot = marks[np.searchsorted(keys, key)]
        windows, left = hi - lo, part.anchor[lo] - part.at[lo]
        text = [part.content(r) for r in runs]
        size = np.fromiter(map(len, text), np.int64, len(text))
        group = key.copy()
        for level in range(1, LEVELS + 1):  # windows of an over-full anchor, by a longer prefix of their own
            k = np.flatnonzero(hot == level)
            k = k[np.argsort(lo[k])]
            begin = part.at[lo[k]]
            own = span_hashes(part.symbols, begin, begin + prefix_length(unit, level))
            group[k] = mix(own ^ mix(key[k] * np.uint64(64) + left[k].astype(np.uint64))) >> np.uint64(24)

        def pack(k):
            cols = ((key, 5), (group, 5), (sig, 8 * unit.words), (low, 8), (high - low, 8), (hot > 0, 1), (windows, 1), (left, 1), (size, 4))
            return len(k), b"".join([bytes([unit.words]), *(planes(x[k].astype(np.uint64), w) for x, w in cols), *(text[i] for i in k)])

        return _rows((group % np.uint64(buckets)).astype(np.int64), int(docs.column("p")[0].as_py()), pack)

    return run


@dataclass
class Runs:
    """Different runs of a bucket: group, windows in each, words or bytes before the anchor, texts, smallest doc_id."""

    group: np.ndarray
    windows: np.ndarray
    left: np.ndarray
    buf: np.ndarray
    off: np.ndarray
    low: np.ndarray


def same_texts(keys: tuple[np.ndarray, ...], buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of texts with equal keys and equal contents: each class's first text, and each text's class.

    ``keys`` should hold a hash of the text; where texts of one hash differ, each of those that differ from the first of
    their hash is a class of its own."""
    n = len(size)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((*keys, size))
    new = np.zeros(n, bool)
    new[0] = True
    for k in (*keys, size):
        new[1:] |= k[order[1:]] != k[order[:-1]]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = np.flatnonzero(head != order)
    for lo in range(0, len(other), 1 << 14):
        k = other[lo : lo + (1 << 14)]
        length = size[order[k]]
        differ = buf[ranges(start[order[k]], length)] != buf[ranges(start[head[k]], length)]
        if differ.any():
            head[k] = np.where(np.bincount(np.repeat(np.arange(len(k)), length), differ, len(k)) > 0, order[k], head[k])
    of = np.empty(n, np.int64)
    of[order] = head
    return np.unique(of, return_inverse=True)


def solve_some(solve: Callable[[Runs], np.ndarray], runs: Runs) -> np.ndarray:
    """What ``solve`` gives for all windows of the runs, from whole groups with about ``SOLVED`` bytes of text at a time."""
    turns = -(-len(runs.buf) // SOLVED)
    if turns < 2:
        return solve(runs)
    turn = (mix(runs.group.astype(np.uint64)) % np.uint64(turns)).astype(np.int64)
    at = np.cumsum(runs.windows) - runs.windows
    best = np.empty(int(runs.windows.sum()), np.int64)
    for i in range(turns):
        k = np.flatnonzero(turn == i)
        if len(k):
            size = runs.off[k + 1] - runs.off[k]
            some = Runs(runs.group[k], runs.windows[k], runs.left[k], runs.buf[ranges(runs.off[k], size)], np.r_[0, np.cumsum(size)], runs.low[k])
            best[ranges(at[k], runs.windows[k])] = solve(some)
    return best


def _answer_runs(solve: Callable[[Runs], np.ndarray]):
    def run(table: pa.Table) -> pa.Table:
        cols, texts, senders, sizes = [[] for _ in range(9)], [], [], []
        for data, n, sender in _blobs(table):
            view, at, hashed = data, 1, bool(data[0])
            for c, w in zip(cols, (5, 5, 8 * hashed, 8, 8, 1, 1, 1, 4)):
                c.append(from_planes(view[at:], n, w))
                at += n * w
            texts.append(np.frombuffer(view[at:], np.uint8))
            senders.append(sender)
            sizes.append(n)
        key, group, sig, low, high, hot, windows, left, size = (np.concatenate(c) for c in cols)
        low, high, windows, left, size, hot = low.astype(np.int64), (low + high).astype(np.int64), windows.astype(np.int64), left.astype(np.int64), size.astype(np.int64), hot > 0
        del cols
        buf, start = np.concatenate(texts), np.cumsum(size) - size
        del texts
        if not hashed:  # the hash of a run of bytes is the hash of its text, which is here
            sig = span_hashes(buf, start, start + size)
        first, cls = same_texts((group, sig, left), buf, start, size)
        least = np.full(len(first), _LAST)
        np.minimum.at(least, cls, low)
        own = buf[ranges(start[first], size[first])]
        runs = Runs(group[first], windows[first], left[first], own, np.r_[0, np.cumsum(size[first])], least)
        best = solve_some(solve, runs)  # of every window of every different run the smallest doc_id
        at = np.cumsum(runs.windows) - runs.windows
        tell = np.minimum.reduceat(best, at)[cls] < high
        out, i = [], 0
        for sender, n in zip(senders, sizes):
            k = np.flatnonzero(tell[i : i + n]) + i
            i += n
            if not len(k):
                continue
            w = windows[k]
            flat = best[ranges(at[cls[k]], w)]
            fresh = np.ones(len(flat), bool)
            fresh[1:] = flat[1:] != flat[:-1]
            begin = np.cumsum(w) - w
            fresh[begin] = True
            pos = np.flatnonzero(fresh)
            length = np.diff(np.r_[pos, len(flat)])
            pieces = np.diff(np.r_[np.searchsorted(pos, begin), len(pos)])
            data = [planes(x.astype(np.uint64), b) for x, b in ((sig[k], 8), (hot[k], 1), (key[k], 5), (pieces, 1), (length, 1), (flat[pos], 8))]
            out.append((int(sender), len(pos), len(k), _zip(b"".join(data))))
        c = list(zip(*out)) if out else [(), (), (), ()]
        return pa.table({"to": pa.array(c[0], pa.int64()), "sender": pa.array(c[1], pa.int64()), "n": pa.array(c[2], pa.int64()), "data": pa.array(c[3], pa.binary())})

    return run


def _covered(part: Part, answers: pa.Table) -> np.ndarray:
    """Which symbols of a part's documents are covered by a window that a smaller doc_id has too."""
    covered = np.zeros(len(part.symbols) + 1, np.int32)
    got = []
    for data, n, m in _blobs(answers):
        view, at, cols = data, 0, []
        for size, w in ((n, 8), (n, 1), (n, 5), (n, 1), (m, 1), (m, 8)):
            cols.append(from_planes(view[at:], size, w))
            at += size * w
        got.append(cols)
    if got and len(part.at):
        sig, hot, key, pieces, length, low = (np.concatenate(c) for c in zip(*got))
        part.split(np.unique(key[hot > 0]))
        begin = np.cumsum(pieces.astype(np.int64)) - pieces.astype(np.int64)
        shared = np.flatnonzero(np.isin(part.key[part.lo], key))
        mine, mine_key = part.signatures(shared), part.key[part.lo[shared]]
        # told runs and own runs of one anchor and hash stand side by side, the told one first
        order = np.lexsort((np.r_[np.zeros(len(sig), np.int8), np.ones(len(mine), np.int8)], np.r_[sig, mine], np.r_[key, mine_key]))
        both_sig, both_key = np.r_[sig, mine][order], np.r_[key, mine_key][order]
        new = np.r_[True, (both_sig[1:] != both_sig[:-1]) | (both_key[1:] != both_key[:-1])]
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        here = np.flatnonzero((order >= len(sig)) & (head < len(sig)))
        run, told = shared[order[here] - len(sig)], head[here]
        n = pieces[told].astype(np.int64)
        piece = ranges(begin[told], n)
        size = length[piece].astype(np.int64)
        doc = np.repeat(part.ids[part.documents(run)], n)
        # where each piece's windows start: the run's first window and the pieces before it
        ends = np.cumsum(size)
        base = np.repeat(np.r_[0, ends][np.cumsum(n) - n], n)
        start = np.repeat(part.at[part.lo[run]], n) + (ends - size - base)
        dup = low[piece].astype(np.int64) < doc
        np.add.at(covered, start[dup], 1)
        np.add.at(covered, start[dup] + size[dup] - 1 + part.unit.length, -1)
    return np.cumsum(covered[:-1]) > 0


def _finish(unit: Unit, names: list[str]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        part = Part(docs, unit)
        gone = _covered(part, answers)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        heads = part.first[:-1][np.diff(part.first) > 0]
        edge[heads] = gone[heads]
        total, begun = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(edge)]
        n = np.diff(part.first)
        removed, runs = np.diff(total[part.first]), np.diff(begun[part.first])
        kept = []
        for i in range(docs.num_rows):
            a, b = part.first[i], part.first[i + 1]
            raw = part.buf[part.off[i] : part.off[i + 1]].tobytes()
            if unit.words:
                words = raw.split()
                kept.append(b" ".join([w for w, g in zip(words, gone[a:b].tolist()) if not g] if removed[i] else words))
            else:
                kept.append(part.buf[a:b][~gone[a:b]].tobytes() if removed[i] else raw)
        cols = {c: docs.column(c) for c in names}
        return pa.table(cols | {"n_symbols": n, "n_removed": removed, "n_spans": runs, "kept": pa.array(kept, pa.binary())})

    return run


def _lean(step):
    """``step`` for Spark, which gives the memory of a group back before the next."""

    def one(table: pa.Table) -> pa.Table:
        out = step(table if "sender" in table.column_names else _documents(table))
        give_back()
        return out

    def two(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = step(_documents(docs), answers)
        give_back()
        return out

    return one if step.__code__.co_argcount == 1 else two


def buckets_for(n: int) -> int:
    """Buckets that the parts of n partitions send to. Every part sends a row to each, which costs more than what the row
    holds once rows are small, so they are few; what a bucket has to solve is cut by :func:`solve_some`."""
    return max(min(n, 32), n // 2)


def remove_repeats(docs: DataFrame, unit: Unit, solve: Callable[[Runs], np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_symbols, n_removed, n_spans and the bytes kept, of every row."""
    n = partitions_for(docs, 8 << 20)
    groups, buckets = 4 * n, buckets_for(n)
    text = docs.select(*dict.fromkeys([*keep, "doc_id", "text"])).withColumn("p", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(groups)))
    parts = text.mapInArrow(_pack_documents, "p long, data binary").repartition(n, "p").groupBy("p")
    anchors = parts.applyInArrow(_lean(_name_anchors(unit, buckets)), _SCHEMA)
    shared = anchors.repartition(n, "to").groupBy("to").applyInArrow(_shared_anchors, _SCHEMA)
    runs = parts.cogroup(shared.groupBy("to")).applyInArrow(_lean(_send_runs(unit, buckets)), _SCHEMA)
    answers = runs.repartition(n, "to").groupBy("to").applyInArrow(_lean(_answer_runs(solve)), _SCHEMA)
    kinds = dict(text.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_symbols long, n_removed long, n_spans long, kept binary"])
    return parts.cogroup(answers.groupBy("to")).applyInArrow(_lean(_finish(unit, keep)), schema)
