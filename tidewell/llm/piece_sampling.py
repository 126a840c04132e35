"""SentencePiece segmentations sampled without replacement, and decoding (operator 10).

Gumbel top-k by a perturbed A-star search: the set of all segmentations of a text has one perturbed
maximum, whose segmentation is drawn first; what is left is split into cells, each with a Gumbel
maximum truncated at the one above, and the best cell is always opened next.  The first k openings
are a sample of k distinct segmentations without replacement, each with its inclusion score.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewell.llm.common import byte_batches, text_or_empty
from tidewell.llm.shingles import mix
from tidewell.operators.sizes import spread

#: Segmentations a text, exponent on piece probabilities (lower: more even), seed.
TOP_K, ALPHA, SEED = 2, 0.7, 11
#: Bytes of text at once, and distinct units whose lattices a worker keeps.
BATCH_BYTES, KEPT_UNITS = 1 << 20, 260_000
#: Units whose lattices are built at once, few enough to stay in cache.
BUILT_UNITS = 6000
BLANK = "▁"
_STEP, _UNIT, _DRAW, _ROLL = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x100000001B3))


class Vocabulary:
    """Pieces of a SentencePiece model as prefix hashes; a character without a piece falls back to its bytes."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        # scores of a BPE model are minus ranks: probabilities follow Zipf's law on them
        zipf = -np.log1p([max(0.0, -self.model.get_score(i)) for i in range(n)])
        logs = alpha * (zipf - np.log(np.exp(zipf).sum()))
        self.byte_log = float(alpha * (-np.log1p(n) - np.log(np.exp(zipf).sum())))
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes] = []
        prefixes: dict[int, int] = {}
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                continue
            self.bytes_of.append(b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace(BLANK, " ").encode())
            if self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) or BLANK in piece.lstrip(BLANK):
                continue
            h = 0
            for c in piece:
                h = (h * int(_ROLL) + ord(c) + 1) & (1 << 64) - 1
                prefixes.setdefault(h, -1)
            prefixes[h] = i
        # where letters meet other characters, units end, if no piece spans such a place
        self.letters_apart = True
        for i in range(n):
            piece = self.model.id_to_piece(i).lstrip(BLANK)
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                self.letters_apart &= all(a.isalpha() == b.isalpha() for a, b in zip(piece, piece[1:], strict=False))
        order = sorted(prefixes)
        self.hashes = np.array(order, np.uint64)
        self.ids = np.array([prefixes[h] for h in order], np.int32)
        self.logs = logs
        self.longest = max(len(self.model.id_to_piece(i)) for i in range(n))
        self.flat_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_ends = np.cumsum([len(x) for x in self.bytes_of])


@dataclass
class Lattice:
    """The lattices of many distinct units, node after node; a unit of n characters has n + 1 nodes.

    A node's arcs go from long to short, as long pieces are the likely ones.
    """

    start: np.ndarray  # first node of each unit
    left: np.ndarray  # characters from a node to the unit's end
    code: np.ndarray  # the character after each node
    first: np.ndarray  # first arc of each node, plus the number of arcs
    run: np.ndarray  # of each arc: the probability of it and its node's arcs before it; over 1 for the last
    length: np.ndarray
    piece: np.ndarray  # id; of a byte arc -1 less its code point
    log: np.ndarray  # conditional log probability, given the node


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 64 random-looking bits, and whether it is a letter."""
    with np.errstate(over="ignore"):
        return mix(np.arange(sys.maxunicode + 1, dtype=np.uint64) + _UNIT), np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def split_units(texts: list[str], letters_apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with their blanks written out and one in front, where each unit starts (and the end), and the units before each text (and all).

    A unit is led by its blanks and ends before the next one; with ``letters_apart`` also where letters meet other characters.
    """
    sizes = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
    codes = np.frombuffer("".join([BLANK + t for t in texts if t]).encode("utf-32-le", "replace"), "<u4").copy()
    codes[codes == 0x20] = ord(BLANK)
    kind = (_characters()[1][codes].view(np.uint8) if letters_apart else np.zeros(len(codes), np.uint8)) + np.uint8(1)
    kind[codes == ord(BLANK)] = 0
    begins = np.zeros(len(codes), bool)
    begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] > 0)
    at = np.concatenate([[0], np.cumsum(sizes)])
    begins[at[:-1][sizes > 0]] = True
    starts = np.append(np.flatnonzero(begins), len(codes))
    return codes, starts, np.searchsorted(starts, at)


class Store:
    """Lattices of the units that a worker has met lately, in arrays that grow by a quarter.

    Units are found by 64-bit hashes of their characters, and the characters themselves are compared
    with the kept ones: should hashes ever collide, the store starts anew with another salt.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.salt = vocab, 0
        self._clear()

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' units, which hold until ``renew``, and the units before each text (and all)."""
        codes, starts, before = split_units(texts, self.vocab.letters_apart)
        while (found := self._kinds(codes, starts)) is None:
            self.salt += 1
            self._clear()
        return found, before

    def _kinds(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray | None:
        if len(starts) < 2:
            return np.zeros(0, np.int64)
        sizes = np.diff(starts)
        place = np.arange(len(codes), dtype=np.int32) - np.repeat(starts[:-1].astype(np.int32), sizes)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(sizes.max()), _ROLL + np.uint64(2 * self.salt), np.uint64), dtype=np.uint64)
            hashes = mix(np.add.reduceat(_characters()[0][codes] * powers[place], starts[:-1]))
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.hashes, distinct)
        known = self.hashes[np.minimum(slot, len(self.hashes) - 1)] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        kinds = np.empty(len(distinct), np.int64)
        kinds[known] = self.kind[slot[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            kinds[fresh] = self.sizes["start"] + np.arange(len(fresh))
            for start in range(0, len(fresh), BUILT_UNITS):
                part = where[fresh[start:start + BUILT_UNITS]]
                self._add(build(codes[_ranges(starts[part], sizes[part])], sizes[part], self.vocab))
            self.hashes, self.kind = np.insert(self.hashes, slot[fresh], distinct[fresh]), np.insert(self.kind, slot[fresh], kinds[fresh])
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
        self.uses[kinds] += np.bincount(inverse, minlength=len(distinct))
        out = kinds[inverse]
        first = self.lattice.start[out]
        same = (self.lattice.left[first] == sizes).all() and (self.lattice.code[_ranges(first, sizes)] == codes).all()
        return out if same else None

    def _add(self, more: Lattice) -> None:
        nodes, arcs = self.sizes["left"], self.sizes["run"]
        more.start += nodes
        more.first += arcs
        self.sizes["first"] = nodes  # the entry after the last node is written anew
        for name, values in vars(more).items():
            had, now = getattr(self.lattice, name), self.sizes[name] + len(values)
            if now > len(had):
                grown = np.empty(max(now, len(had) + len(had) // 4), had.dtype)
                grown[:self.sizes[name]] = had[:self.sizes[name]]
                setattr(self.lattice, name, grown)
                had = grown
            had[self.sizes[name]:now] = values
            self.sizes[name] = now

    def _clear(self) -> None:
        self.lattice = build(np.zeros(0, np.uint32), np.zeros(0, np.int64), self.vocab)
        self.sizes = {name: len(values) for name, values in vars(self.lattice).items()}
        self.hashes, self.kind, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def renew(self, most: int = KEPT_UNITS) -> None:
        """Of more than ``most`` units, the most used half stays (those used once go)."""
        n = self.sizes["start"]
        if n <= most:
            return
        had, start = self.lattice, self.lattice.start[:n]
        stay = np.sort(np.argpartition(-self.uses, most // 2)[:most // 2])
        stay = stay[self.uses[stay] > 1]
        nodes = had.left[start[stay]] + 1
        at_node = _ranges(start[stay], nodes)
        arcs = had.first[at_node + 1] - had.first[at_node]
        at_arc = _ranges(had.first[at_node], arcs)
        number = np.full(n, -1, np.int64)
        number[stay] = np.arange(len(stay))
        self.lattice = Lattice(np.cumsum(nodes, dtype=np.int64) - nodes, had.left[at_node], had.code[at_node], np.concatenate([[0], np.cumsum(arcs)]).astype(np.int32),
                               had.run[at_arc], had.length[at_arc], had.piece[at_arc], had.log[at_arc])
        self.sizes = {name: len(values) for name, values in vars(self.lattice).items()}
        kept = number[self.kind] >= 0
        self.hashes, self.kind, self.uses = self.hashes[kept], number[self.kind[kept]], self.uses[stay] // 2


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size says."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def build(codes: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> Lattice:
    """The lattices of units, given by the code points of all and the length of each."""
    unit = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    start = ends - sizes + np.arange(len(sizes))
    left_char = ends[unit] - np.arange(len(codes))
    n_nodes = len(codes) + len(sizes)
    node_of = np.arange(len(codes)) + unit
    left = np.zeros(n_nodes, np.int64)
    left[node_of] = left_char
    code = np.zeros(n_nodes, np.uint32)
    code[node_of] = codes

    at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
    covered = np.zeros(len(codes), bool)
    parts = []
    with np.errstate(over="ignore"):
        for n in range(1, vocab.longest + 1):
            more = left_char[at] >= n
            at, h = at[more], h[more] * _ROLL + codes[at[more] + n - 1] + np.uint64(1)
            slot = np.minimum(np.searchsorted(vocab.hashes, h), len(vocab.hashes) - 1)
            known = vocab.hashes[slot] == h
            at, h, slot = at[known], h[known], slot[known]
            ids = vocab.ids[slot]
            whole = ids >= 0
            if n == 1:
                covered[at[whole]] = True
            parts.append((at[whole], np.full(int(whole.sum()), n), ids[whole], vocab.logs[ids[whole]]))
            if not len(at):
                break
    bare = np.flatnonzero(~covered)
    width = 1 + (codes[bare] > 0x7F).astype(np.int64) + (codes[bare] > 0x7FF) + (codes[bare] > 0xFFFF)
    parts.append((bare, np.ones(len(bare), np.int64), -1 - codes[bare].astype(np.int32), width * vocab.byte_log))
    src, length, piece, log = (np.concatenate(x) for x in zip(*parts[::-1], strict=True))
    order = np.argsort(_narrow(src), kind="stable")
    src, length, piece, log = src[order], length[order], piece[order], log[order]
    node = node_of[src]

    total = np.zeros(n_nodes)  # log of the sum over all ways from a node to the unit's end
    by_left = np.argsort(_narrow(left_char[src]), kind="stable")
    levels = left_char[src][by_left]
    cuts = np.concatenate([np.flatnonzero(np.diff(levels, prepend=-1)), [len(levels)]]) if len(levels) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        arcs = by_left[a:b]
        value = log[arcs] + total[node[arcs] + length[arcs]]
        heads = np.flatnonzero(np.diff(node[arcs], prepend=-1))
        most = np.maximum.reduceat(value, heads)
        spread = np.diff(np.append(heads, len(arcs)))
        total[node[arcs[heads]]] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, spread)), heads))
    log = np.minimum(log + total[node + length] - total[node], 0.0)
    first = np.searchsorted(node, np.arange(n_nodes + 1)).astype(np.int64)
    run = np.exp(log)
    nth = np.arange(len(node)) - first[node]
    for j in range(1, int(nth.max()) + 1 if len(nth) else 0):  # node by node, so that sums don't depend on other units
        at = np.flatnonzero(nth == j)
        run[at] += run[at - 1]
    if len(run):
        run[first[node + 1] - 1] = 2.0
    return Lattice(start, left.astype(np.int32), code, first.astype(np.int32), run.astype(np.float32), length.astype(np.int8), piece.astype(np.int32), log.astype(np.float32))


def _narrow(x: np.ndarray) -> np.ndarray:
    """In 16 bits where they fit: those are sorted by radix."""
    return x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x


def uniform(key: np.ndarray, draw: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from a key and a counter: the same for the same row, wherever it is handled."""
    with np.errstate(over="ignore"):
        return ((mix(key + np.asarray(draw, np.uint64) * _STEP) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sample_paths(lattice: Lattice, units: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segmentation of each unit by its probability: arcs unit after unit, arcs per unit, log probabilities."""
    node, live = lattice.start[units].copy(), np.arange(len(units))
    logs, counts = np.zeros(len(units)), np.zeros(len(units), np.int64)
    owners, chosen, step = [], [], 0
    while len(live):
        at = node[live]
        arc, u = lattice.first[at], uniform(keys[live], step)
        on = np.flatnonzero(u >= lattice.run[arc])
        while len(on):
            arc[on] += 1
            on = on[u[on] >= lattice.run[arc[on]]]
        logs[live] += lattice.log[arc].astype(np.float64)
        counts[live] += 1
        owners.append(live)
        chosen.append(arc)
        node[live] = at + lattice.length[arc]
        live = live[lattice.left[node[live]] > 0]
        step += 1
    if not owners:
        return np.zeros(0, np.int64), counts, logs
    owner, arcs = np.concatenate(owners), np.concatenate(chosen)
    return arcs[np.argsort(owner, kind="stable")], counts, logs


def sample_other(lattice: Lattice, unit: int, excluded: list[tuple[int, ...]], key: np.uint64) -> tuple[tuple[int, ...], float]:
    """A segmentation of one unit outside ``excluded``, by probability; and its log probability (not renormalised)."""
    node, path, log, step = int(lattice.start[unit]), [], 0.0, 0
    inside = excluded
    while lattice.left[node]:
        a, b = int(lattice.first[node]), int(lattice.first[node + 1])
        share = np.exp(lattice.log[a:b].astype(np.float64))
        full = share.copy()
        for e in inside:  # what an excluded path takes from its arc
            share[e[step] - a] -= np.exp(lattice.log[list(e[step:])].astype(np.float64).sum())
        for e in inside:
            at = e[step] - a
            if share[at] < 1e-4 * full[at]:  # perhaps rounding is all that is left: is it the arc's only way on?
                only = len(e) == step + 1 or all(lattice.first[n + 1] - lattice.first[n] == 1 for n in _nodes_after(lattice, e, step, node))
                share[at] = 0.0 if only or share[at] < 0 else share[at]
        run = np.cumsum(share)
        arc = a + min(int(np.searchsorted(run, float(uniform(np.array([key]), step)[0]) * run[-1], side="right")), b - a - 1)
        inside = [e for e in inside if e[step] == arc]
        path.append(arc)
        log += float(lattice.log[arc])
        node += int(lattice.length[arc])
        step += 1
    return tuple(path), log


def _nodes_after(lattice: Lattice, path: tuple[int, ...], step: int, node: int) -> list[int]:
    """The nodes that a path visits after its arc ``step``, which starts at ``node``."""
    out = []
    for arc in path[step:-1]:
        node += int(lattice.length[arc])
        out.append(node)
    return out


def _log_rest(p: np.ndarray) -> np.ndarray:
    """log(1 - exp(p)) of non-positive p."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p < 0, np.where(p > -0.7, np.log(-np.expm1(p)), np.log1p(-np.exp(p))), -np.inf)


def truncated(mass: np.ndarray, top: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel values with log mass ``mass``, given that they don't exceed ``top``."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.log(np.exp(mass - top) - np.log(u)))


@dataclass
class Drawn:
    arcs: np.ndarray
    counts: np.ndarray
    logs: np.ndarray
    value: float


def top_k(texts: list[str], keys: list[int], store: Store, k: int) -> list[list[tuple[bytes, int, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations, best perturbed value first: ids, pieces, log probability, perturbed value, log inclusion score.

    The inclusion score is the probability to exceed the (k+1)-th perturbed value: 1 - exp(-exp(log p - that)); 1 where there is none.
    """
    store.renew()
    flat, before = store.texts(texts)
    kinds = [flat[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
    lattice, vocab, n = store.lattice, store.vocab, len(texts)
    base = mix(np.array([x & (1 << 64) - 1 for x in keys], np.uint64))
    roots = -np.log(-np.log(uniform(base, 1 << 40)))
    drawn: list[list[Drawn]] = [[] for _ in range(n)]
    heaps: list[list] = [[] for _ in range(n)]
    with np.errstate(over="ignore"):
        salt = lambda d, s, i: mix(base[d] + np.uint64(s) * _DRAW + np.asarray(i, np.uint64) * _UNIT)
        jobs = [(d, 0, -1, None) for d in range(n) if len(kinds[d])]
        for s in range(k):
            tails = [kinds[d][i + 1:] for d, i, _, _ in jobs] if s else [kinds[d] for d, *_ in jobs]
            froms = [i + 1 if s else 0 for _, i, _, _ in jobs]
            spread = np.array([len(t) for t in tails], np.int64)
            unit_at = np.concatenate([[0], np.cumsum(spread)])
            which = np.arange(unit_at[-1]) + np.repeat(np.array(froms, np.int64) - unit_at[:-1], spread)  # place in its text
            owners = np.repeat(np.array([d for d, *_ in jobs], np.int64), spread)
            arcs, counts, logs = sample_paths(lattice, np.concatenate(tails) if tails else np.zeros(0, np.int64), salt(owners, s, which))
            arc_at = np.concatenate([[0], np.cumsum(counts)])
            # what comes before each tail, and the value that all its cells stay below
            heads: list[tuple] = []
            for d, i, source, cell in jobs:
                if s == 0:
                    heads.append((0.0, float(roots[d]), None, None))
                    continue
                old, excluded = drawn[d][source], cell[1]
                path, log = sample_other(lattice, int(kinds[d][i]), excluded, salt(d, s, np.array([i]))[0])
                heads.append((float(old.logs[:i].sum()) + log, cell[0], path, log))
            base_log, top = (np.repeat(np.array([h[x] for h in heads]), spread) for x in (0, 1))
            # cells of what is left: same units before, another segmentation of this unit, any after
            run = np.empty_like(logs)  # summed text by text, so that values don't depend on the batch
            for a, b in zip(unit_at[:-1].tolist(), unit_at[1:].tolist(), strict=True):
                run[a:b] = np.cumsum(logs[a:b]) - logs[a:b]
            mass = base_log + run + _log_rest(logs)
            values = truncated(mass, top, uniform(salt(owners, s, which), 1 << 41))
            for j, (d, i, source, cell) in enumerate(jobs):
                a, b = int(unit_at[j]), int(unit_at[j + 1])
                new_arcs, new_counts, new_logs = arcs[arc_at[a]:arc_at[b]], counts[a:b], logs[a:b]
                _, value, path, log = heads[j]
                if s:
                    old = drawn[d][source]
                    cut = int(old.counts[:i].sum())
                    new_arcs = np.concatenate([old.arcs[:cut], np.array(path, np.int64), new_arcs])
                    new_counts = np.concatenate([old.counts[:i], [len(path)], new_counts])
                    new_logs = np.concatenate([old.logs[:i], [log], new_logs])
                drawn[d].append(Drawn(new_arcs, new_counts, new_logs, value))
                mine, cells = len(drawn[d]) - 1, values[a:b]
                best = np.argpartition(-cells, k - 1)[:k] if b - a > k else np.arange(b - a)
                for c in best.tolist():
                    if cells[c] > -np.inf:
                        heapq.heappush(heaps[d], (-float(cells[c]), s, froms[j] + c, mine, None))
                if s:
                    excluded = [*cell[1], path]
                    rest = -np.expm1(_log_sum([float(lattice.log[list(e)].sum()) for e in excluded]))
                    if rest > 1e-12:
                        value_here = truncated(np.array([new_logs[:i].sum() + np.log(rest)]), value, uniform(salt(d, s, np.array([i])), 1 << 42))[0]
                        heapq.heappush(heaps[d], (-float(value_here), s, i, mine, excluded))
            jobs = []
            for d in range(n):
                if s + 1 < k and heaps[d]:
                    neg, _, i, source, excluded = heapq.heappop(heaps[d])
                    if excluded is None:
                        old = drawn[d][source]
                        at = int(old.counts[:i].sum())
                        excluded = [tuple(old.arcs[at:at + int(old.counts[i])].tolist())]
                    jobs.append((d, i, source, (-neg, excluded)))
    out = []
    for d in range(n):
        rows = []
        beyond = -heaps[d][0][0] if heaps[d] else -np.inf
        for x in drawn[d]:
            log = float(x.logs.sum())
            gap = log - beyond
            inclusion = 0.0 if np.isinf(gap) or gap > 30 else float(gap if gap < -30 else np.log(-np.expm1(-np.exp(gap))))
            ids = ids_of(lattice, x.arcs, vocab)
            rows.append((ids.tobytes(), len(ids), log, x.value, inclusion))
        out.append(rows or [(b"", 0, 0.0, 0.0, 0.0)])
    return out


def _log_sum(logs: list[float]) -> float:
    top = max(logs)
    return min(0.0, top + float(np.log(sum(np.exp(x - top) for x in logs))))


def ids_of(lattice: Lattice, arcs: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Little-endian unsigned 32-bit ids; byte arcs give an id for each byte."""
    ids = lattice.piece[arcs]
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids.astype("<u4")
    out, last = [], 0
    for at in bare.tolist():
        out += [ids[last:at], [vocab.byte_ids[b] for b in chr(-1 - int(ids[at])).encode()]]
        last = at + 1
    return np.concatenate([*out, ids[last:]]).astype("<u4")


_loaded: dict[tuple[str, float], Store] = {}


def store_of(path: str, alpha: float) -> Store:
    """A worker's store for a model."""
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Store(Vocabulary(path, alpha))
    return _loaded[path, alpha]


def sample_segmentations(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", k: int = TOP_K, alpha: float = ALPHA, seed: int = SEED, decode: bool = False) -> DataFrame:
    """``(<id_col>, sample, input_ids, n_pieces, log_prob, perturbed, log_inclusion)``: ``k`` distinct segmentations of every whole text; with ``decode`` also ``decoded``, the text of the ids as ``decode_pieces`` gives it.

    ``input_ids`` are little-endian unsigned 32-bit ids of the SentencePiece ``model``; samples are
    numbered from 0 by falling perturbed value.  A segmentation's probability is the product of its
    pieces' (Zipf's law on a BPE model's ranks, to the power ``alpha``), normalised over the text's
    lattice.  Pieces never hold a blank inside, so the lattice is a chain of the lattices of blank-led
    units; equal units of a batch share one.  Texts with fewer segmentations than ``k`` give fewer rows.

    Draws depend on ``seed``, the row's id and places in the text only: the same row gives the same
    result in any partition and on any retry, and rows with equal ids and texts the same one.
    Null and empty texts have one segmentation, the empty one; a null id is a key of its own.  An
    empty table gives no rows; other columns are ignored.  No shuffle.
    """
    source = spread(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"), text_or_empty(text_col).alias("text")))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(model, alpha)
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            found = top_k(batch.column("text").to_pylist(), batch.column("key").to_pylist(), store, k)
            at = [i for i, rows in enumerate(found) for _ in rows]
            nth = [s for rows in found for s in range(len(rows))]
            ids, pieces, logs, values, scores = zip(*(r for rows in found for r in rows), strict=True)
            more = [pa.array(decode_ids(list(ids), store.vocab), pa.string())] if decode else []
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(at)), pa.array(nth, pa.int32()), pa.array(ids, pa.binary()), pa.array(pieces, pa.int64()),
                pa.array(logs, pa.float64()), pa.array(values, pa.float64()), pa.array(scores, pa.float64()), *more],
                names=["id", "sample", "input_ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", *["decoded"] * decode])

    schema = f"id {id_type}, sample int, input_ids binary, n_pieces long, log_prob double, perturbed double, log_inclusion double" + ", decoded string" * decode
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_ids(rows: list[bytes], vocab: Vocabulary) -> list[str]:
    """The text of each row of ids."""
    ids = np.frombuffer(b"".join(rows), "<u4")
    ends = vocab.byte_ends[ids]
    sizes = np.diff(vocab.byte_ends, prepend=0)[ids]
    data = vocab.flat_bytes[_ranges(ends - sizes, sizes)].tobytes()
    at = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *(len(r) // 4 for r in rows)])].tolist()
    return [data[a + (data[a:a + 1] == b" " and a < b):b].decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def decode_pieces(encoded: DataFrame, model: str, *, ids_col: str = "input_ids", alpha: float = ALPHA) -> DataFrame:
    """``encoded`` with ``decoded`` (replacing a column of that name): the text of the ids, null for null ids; all rows stay.

    Control and unknown ids give nothing; the blank that encoding puts first is taken off.
    """
    source = encoded.drop("decoded")
    kept = source.columns
    schema = StructType(source.schema.fields + [StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = store_of(model, alpha).vocab
        for batch in byte_batches(batches, ids_col, 4 * BATCH_BYTES):
            rows = batch.column(ids_col).to_pylist()
            texts = iter(decode_ids([x for x in rows if x is not None], vocab))
            decoded = pa.array([None if x is None else next(texts) for x in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), decoded], names=[*kept, "decoded"])

    return source.mapInArrow(run, schema)
