"""Weighted acyclic automata over sequences of word numbers, built level by level in numpy.

An automaton accepts the sequences; states with equal continuations are one state. Each arc
knows how many sequences its state accepts before it, so a path through the automaton gives
the number of its sequence, and the weights stand in that order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


def summed(sequences: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and the sums of their weights."""
    if not len(sequences):
        return sequences, weights
    base = int(sequences.max()) + 1
    keys: list[np.ndarray] = []  # columns, packed as many to a 64-bit key as fit; no other copy of the rows is made
    room = 0
    for column in sequences.T:
        if keys and room * base < 1 << 62:
            keys[-1] *= base
            keys[-1] += column
            room *= base
        else:
            keys.append(column.astype(np.int64))
            room = base
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[0] = True
    while keys:
        key = keys.pop()[order]
        new[1:] |= key[1:] != key[:-1]
    del key
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(weights[order], starts)
    return sequences[order[starts]], sums


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if k is np.int64 or top <= np.iinfo(k).max))


_KINDS = [np.dtype(k) for k in (bool, np.uint8, np.uint16, np.uint32, np.int64, np.uint64)]


def _framed(arrays: list[np.ndarray]) -> bytes:
    """Arrays behind each other, their kinds and lengths before; far shorter to write and read than NumPy's own files."""
    head = np.array([x for a in arrays for x in (_KINDS.index(a.dtype), len(a))], np.int64)
    return b"".join([head.tobytes(), *(part for a in arrays for part in (a.tobytes(), bytes(-a.nbytes % 8)))])


def _unframed(data: bytes, n: int) -> list[np.ndarray]:
    head, at, found = np.frombuffer(data, np.int64, 2 * n).tolist(), 16 * n, []
    for kind, length in zip(head[::2], head[1::2], strict=True):
        found.append(np.frombuffer(data, _KINDS[kind], length, at))
        at += -(-found[-1].nbytes // 8) * 8
    return found


@dataclass
class Automaton:
    """Arcs of state s are first[s] to first[s + 1]; state 0 accepts the empty rest only, the last state is the start."""

    words: np.ndarray  # what label k + 1 stands for, ascending
    first: np.ndarray
    label: np.ndarray
    target: np.ndarray
    final: np.ndarray
    weights: np.ndarray
    levels: np.ndarray  # where the states of each depth end, the deepest first
    skip: np.ndarray  # sequences of an arc's state that come before those of the arc

    @staticmethod
    def build(words: np.ndarray, sequences: np.ndarray, weights: np.ndarray) -> Automaton:
        """From distinct sequences in order; a row is one sequence of labels, with zeros behind it."""
        n, depth = sequences.shape
        lengths = (sequences > 0).sum(axis=1)
        new = np.ones((depth + 1, n), bool)
        new[0, 1:] = False
        for d in range(depth):
            new[d + 1, 1:] = new[d, 1:] | (sequences[1:, d] != sequences[:-1, d])
        arcs_of, labels, targets, finals, levels = [np.zeros(1, np.int64)], [], [], [np.ones(1, bool)], [1]
        states = 1
        below = np.zeros(int((new[depth] & (lengths == depth)).sum()), np.int64)
        for d in range(depth - 1, -1, -1):
            # nodes at depth d, and the arcs from them to the nodes of depth d + 1
            starts = np.flatnonzero(new[d] & (lengths >= d)) if n else np.zeros(1, np.int64)
            final = lengths[starts] == d if n else np.zeros(1, bool)
            rows = np.flatnonzero(new[d + 1] & (lengths > d))
            label = sequences[rows, d].astype(np.int64)
            owner = np.searchsorted(starts, rows, side="right") - 1
            counts = np.bincount(owner, minlength=len(starts))
            ends = np.cumsum(counts)
            each = _mixed(_mixed(label.astype(np.uint64) + _MULTIPLIER) + below.astype(np.uint64))
            sums = np.append(np.uint64(0), np.cumsum(each))
            mark = sums[ends] - sums[ends - counts] + _mixed(counts.astype(np.uint64) * np.uint64(2) + final.astype(np.uint64))
            _, chosen, group = np.unique(mark, return_index=True, return_inverse=True)
            offset = np.arange(len(rows)) - np.repeat(ends - counts, counts)
            kept = (ends - counts)[chosen[group]]
            same = np.array_equal(counts, counts[chosen[group]]) and np.array_equal(final, final[chosen[group]])
            if not same or not all(np.array_equal(x, x[np.repeat(kept, counts) + offset]) for x in (label, below)):
                chosen = group = np.arange(len(starts))  # two marks were equal by chance: this level stays as it is
            # numbered by first use, so that most targets are the next number
            by = np.argsort(chosen, kind="stable")
            place = np.empty_like(by)
            place[by] = np.arange(len(by))
            chosen, group = chosen[by], place[group]
            leaf = (counts[chosen] == 0) & final[chosen]
            number = np.where(leaf, 0, states + np.cumsum(~leaf) - 1)
            arcs_of.append(counts[chosen][~leaf])
            finals.append(final[chosen][~leaf])
            used = chosen[~leaf]
            place = np.repeat((ends - counts)[used], counts[used]) + np.arange(int(counts[used].sum())) - np.repeat(np.cumsum(counts[used]) - counts[used], counts[used])
            labels.append(label[place])
            targets.append(below[place])
            states += int((~leaf).sum())
            levels.append(states)
            below = number[group]
        first = np.append(0, np.cumsum(np.concatenate(arcs_of)))
        return Automaton.of(words, first, np.concatenate(labels), np.concatenate(targets), np.concatenate(finals), weights, np.array(levels))

    @staticmethod
    def of(words: np.ndarray, first: np.ndarray, label: np.ndarray, target: np.ndarray, final: np.ndarray, weights: np.ndarray, levels: np.ndarray) -> Automaton:
        """With the arcs' counts worked out, from the deepest level up."""
        accepted = final.astype(np.int64)
        skip = np.zeros(len(label), np.int64)
        for low, high in zip(levels[:-1], levels[1:], strict=True):
            arcs = slice(first[low], first[high])
            took = np.cumsum(accepted[target[arcs]])
            sums = np.append(0, took)
            starts = sums[first[low:high] - first[low]]
            skip[arcs] = sums[:-1] - np.repeat(starts - final[low:high], np.diff(first[low : high + 1]))
            accepted[low:high] += sums[first[low + 1 : high + 1] - first[low]] - starts
        return Automaton(words, first, label, target, final, weights, levels, skip)

    def pack(self, known: np.ndarray) -> bytes:
        """Arrays as narrow as they can be; a target is 0 for the state of no arcs, 1 for the next new state, more for an older one.

        Words that stand in ``known`` (ascending) are written as steps from place to place there.
        """
        at = np.searchsorted(known, self.words)
        there = known[np.minimum(at, len(known) - 1)] == self.words if len(known) else np.zeros(len(at), bool)
        before = np.maximum.accumulate(np.append(0, self.target))[:-1]
        code = np.where(self.target == 0, 0, before + 2 - self.target)
        arrays = (self.words[~there], np.diff(at[there], prepend=0), np.diff(self.first), self.label, code, self.final, self.weights, self.levels)
        return zstandard.ZstdCompressor(level=1).compress(_framed([x if x.dtype in (bool, np.uint64) else _narrow(x) for x in arrays]))

    @staticmethod
    def unpack(data: bytes, known: np.ndarray) -> Automaton:
        rare, steps, arcs, label, code, final, weights, levels = _unframed(zstandard.ZstdDecompressor().decompress(data), 8)
        words = np.sort(np.concatenate([rare, known[np.cumsum(steps, dtype=np.int64)]]))
        first = np.append(0, np.cumsum(arcs.astype(np.int64)))
        code = code.astype(np.int64)
        newest = np.cumsum(code == 1)
        target = np.where(code == 0, 0, np.where(code == 1, newest, newest + 2 - code))
        return Automaton.of(words, first, label.astype(np.int32), target, final, weights.astype(np.int64), levels.astype(np.int64))

    def sequences(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """All sequences as rows of labels, and their weights."""
        state = np.array([len(self.first) - 2])
        number = np.zeros(1, np.int64)
        rows = np.zeros((1, depth), np.int32)
        found, weights = [], []
        for d in range(depth + 1):
            ends = self.final[state]
            found.append(rows[ends])
            weights.append(self.weights[number[ends]])
            if d == depth:
                break
            counts = self.first[state + 1] - self.first[state]
            arcs = np.repeat(self.first[state] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            rows = np.repeat(rows, counts, axis=0)
            rows[:, d] = self.label[arcs]
            number = np.repeat(number, counts) + self.skip[arcs]
            state = self.target[arcs]
        return np.concatenate(found), np.concatenate(weights)

    def compose(self, asked: np.ndarray) -> np.ndarray:
        """Weights of sequences of words (rows, zeros behind them): walks all through the arcs at once; 0 where one isn't accepted."""
        state = np.full(len(asked), len(self.first) - 2, np.int64)
        number = np.zeros(len(asked), np.int64)
        alive = np.ones(len(asked), bool)
        for column in asked.T:
            going = alive & (column != 0)
            label = np.searchsorted(self.words, column)
            known = self.words[np.minimum(label, len(self.words) - 1)] == column if len(self.words) else np.zeros(len(column), bool)
            low, end = self.first[state], self.first[state + 1]
            high = end.copy()
            while (open_ := low < high).any():
                middle = (low + high) // 2
                less = open_ & (self.label[np.minimum(middle, max(0, len(self.label) - 1))] < label + 1)
                low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
            at = np.minimum(low, max(0, len(self.label) - 1))
            met = known & (low < end) & (self.label[at] == label + 1) if len(self.label) else np.zeros(len(column), bool)
            alive &= ~going | met
            step = going & met
            number = np.where(step, number + self.skip[at], number) if len(self.label) else number
            state = np.where(step, self.target[at], state) if len(self.label) else state
        alive &= self.final[state]
        return np.where(alive, self.weights[np.where(alive, number, 0)], 0) if len(self.weights) else np.zeros(len(asked), np.int64)


def union(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, sequences and summed weights of several (words, sequences, weights); ``parts`` is emptied, so that no row is held twice."""
    words = np.unique(np.concatenate([w for w, _, _ in parts]))
    weights = np.concatenate([w for _, _, w in parts])
    rows = np.empty((len(weights), parts[0][1].shape[1]), np.int32)
    end = len(weights)
    while parts:
        own, sequences, _ = parts.pop()
        number = np.append(0, np.searchsorted(words, own) + 1).astype(np.int32)
        for k, column in enumerate(sequences.T):
            rows[end - len(sequences) : end, k] = number[column]
        end -= len(sequences)
    return words, *summed(rows, weights)
