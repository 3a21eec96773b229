"""A shard in memory: its vectors, sign hashes and graph, and best-first walks of many queries at a time.

Walks go in rounds.  A round takes each query's ``step`` best pool members
that are not expanded yet, meets their neighbours, drops those that bounds
rule out, and keeps the best of old and new.  What a query finds depends on
the shard and the query only, not on the other queries of its block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .srp import LEVELS, TOP, pack

#: A shard as one row: members in order of descending norm, ties by id; ``offsets`` and ``nbrs`` are the graph by position.
PACKED = "chunk int, shard int, n int, dim int, max_norm double, ids array<bigint>, norms array<double>, words array<int>, offsets array<int>, nbrs array<int>, x array<double>"
#: Queries that walk together; with the members of a shard they bound the table of what was seen.
BLOCK, SEEN_BYTES = 256, 64 << 20


def listed(values: np.ndarray) -> pa.Array:
    """One row that holds all of ``values``."""
    return pa.ListArray.from_arrays(np.array([0, len(values)], np.int32), pa.array(values))


def csr(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, targets) of edges that are in order of ``src``."""
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]).astype(np.int32), dst.astype(np.int32)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... of each stretch, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def first_of(groups: np.ndarray, n: int) -> np.ndarray:
    """Which entries are among the first ``n`` of their group; equal groups are together."""
    begin = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(groups)]]))) < n


def products(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, at_once: int = 8_192) -> np.ndarray:
    """Products of the rows ``a`` of ``x`` with the rows ``b`` of ``y``, summed in the order of the entries, as the column functions do."""
    out = np.zeros(len(a))
    for at in range(0, len(a), at_once):
        on = slice(at, at + at_once)
        each, total = np.ascontiguousarray((x[a[on]] * y[b[on]]).T), out[on]
        for row in each:
            total += row
    return out


@dataclass
class Found:
    """For each query of a block the members of its pool, best first, with their products, and the products computed."""

    query: np.ndarray
    member: np.ndarray
    ip: np.ndarray
    cost: np.ndarray


class Shard:
    def __init__(self, ids, norms, words, offsets, nbrs, x):
        self.ids, self.norms, self.words, self.offsets, self.nbrs, self.x = ids, norms, words, offsets, nbrs, x
        self.n = len(ids)
        # each hash table: members in order of (hash, position)
        self.order = [np.argsort(words[:, t], kind="stable") for t in range(words.shape[1])] if words.size else []
        self.sorted = [words[o, t] for t, o in enumerate(self.order)]

    @classmethod
    def unpacked(cls, batch: pa.RecordBatch, i: int = 0) -> Shard:
        get = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
        n, dim = batch.column("n")[i].as_py(), batch.column("dim")[i].as_py()
        return cls(get("ids"), get("norms"), get("words").reshape(n, -1), get("offsets"), get("nbrs"), get("x").reshape(n, dim))

    def packed(self, chunk: int, shard: int) -> pa.Table:
        columns = {
            "chunk": pa.array([chunk], pa.int32()), "shard": pa.array([shard], pa.int32()), "n": pa.array([self.n], pa.int32()), "dim": pa.array([self.x.shape[1]], pa.int32()),
            "max_norm": pa.array([float(self.norms[0])]), "ids": listed(self.ids.astype(np.int64)), "norms": listed(self.norms), "words": listed(self.words.astype(np.int32).ravel()),
            "offsets": listed(self.offsets.astype(np.int32)), "nbrs": listed(self.nbrs.astype(np.int32)), "x": listed(self.x.ravel()),
        }
        return pa.table(columns)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Positions of those of ``ids`` that are members."""
        if not hasattr(self, "by_id"):
            self.by_id = np.argsort(self.ids)
        at = np.minimum(np.searchsorted(self.ids[self.by_id], ids), self.n - 1)
        return self.by_id[at[self.ids[self.by_id[at]] == ids]]

    def seeds(self, words: np.ndarray, ub: int) -> list[np.ndarray]:
        """Members in the smallest windows around each query's words that hold ``ub`` entries, at most ub + 1 of them.

        The windows are aligned blocks of doubling size and the value after;
        entries count in each table, members once, in order of (table, hash, position).
        """
        level = np.arange(-1, LEVELS)
        shift = np.maximum(level, 0)
        low = (words[:, :, None] >> shift) << shift
        high = np.where(level < 0, words[:, :, None], np.minimum(low + (1 << shift), TOP))
        low = np.where(level < 0, words[:, :, None], low)
        begin = np.stack([np.searchsorted(s, low[:, t]) for t, s in enumerate(self.sorted)], axis=1)
        end = np.stack([np.searchsorted(s, high[:, t], side="right") for t, s in enumerate(self.sorted)], axis=1)
        enough = (end - begin).sum(axis=1) >= ub
        stop = np.where(enough.any(axis=1), enough.argmax(axis=1), len(level) - 1)
        out = []
        for i, s in enumerate(stop):
            met = np.concatenate([o[begin[i, t, s] : end[i, t, s]] for t, o in enumerate(self.order)])
            _, at = np.unique(met, return_index=True)
            out.append(met[np.sort(at)[: ub + 1]])
        return out

    def walk(self, q: np.ndarray, words: np.ndarray | None, starts: list[np.ndarray], k: int, ef: int, floor: np.ndarray | None = None, norm_prune: bool = False, cos: np.ndarray | None = None, step: int = 1, skip: np.ndarray | None = None) -> Found:
        """Best-first walks of the queries ``q`` with pools of k + ef.

        A neighbour is left out if its norm, or its norm times the bound on
        its cosine (``cos``, by differing bits of ``words``), is below the
        k-th best product that is known: of the walk, or ``floor``.  Only this
        bound is safe; ``floor`` and norms are those of unit queries.
        ``skip``: for each query a member that it never meets.

        Where a pool holds the whole shard and nothing prunes, all that can
        be reached is found in any order, so a round expands all at once.
        """
        b, pool = len(q), k + ef
        seen = np.zeros((b, self.n), bool)
        if skip is not None:
            seen[np.arange(b), skip] = True
        floor = np.full(b, -np.inf) if floor is None else floor
        who = np.repeat(np.arange(b), [len(s) for s in starts])
        member = np.concatenate(starts) if b else np.zeros(0, np.int64)
        fresh = ~seen[who, member]
        who, member = who[fresh], member[fresh]
        seen[who, member] = True
        ip = np.einsum("ij,ij->i", self.x[member], q[who])
        done = np.zeros(len(who), bool)
        cost = np.bincount(who, minlength=b)
        if step and pool >= self.n and not norm_prune and cos is None:
            who, member = self.reached(who, member, seen)
            return self.best(Found(who, member, products(self.x, member, q, who), np.bincount(who, minlength=b)), pool)
        while True:
            order = np.lexsort((self.ids[member], -ip, who))
            order = order[first_of(who[order], pool)]
            who, member, ip, done = who[order], member[order], ip[order], done[order]
            todo = np.flatnonzero(~done)
            todo = todo[first_of(who[todo], step)]
            if not len(todo):
                return Found(who, member, ip, cost)
            done[todo] = True
            counts = self.offsets[member[todo] + 1] - self.offsets[member[todo]]
            near, of = self.nbrs[spread(self.offsets[member[todo]], counts)], np.repeat(who[todo], counts)
            fresh = ~seen[of, near]
            of, near = of[fresh], near[fresh]
            if step > 1:
                both = np.unique(of.astype(np.int64) * self.n + near)
                of, near = both // self.n, both % self.n
            seen[of, near] = True
            if norm_prune or cos is not None:
                bound, kth = floor.copy(), first_of(who, k) & ~first_of(who, k - 1)
                bound[who[kth]] = np.maximum(bound[who[kth]], ip[kth])
                reach = self.norms[near]
                if cos is not None:
                    reach = reach * cos[np.bitwise_count(self.words[near] ^ words[of]).sum(axis=1)]
                keep = reach >= bound[of]
                of, near = of[keep], near[keep]
            cost += np.bincount(of, minlength=b)
            new, size, last = np.einsum("ij,ij->i", self.x[near], q[of]), np.bincount(who, minlength=b), np.full(b, -np.inf)
            last[size == pool] = ip[np.cumsum(size)[size == pool] - 1]
            keep = ~(new < last[of])  # the others would be cut from a full pool: most, once a walk is near its end
            of, near, new = of[keep], near[keep], new[keep]
            who, member = np.concatenate([who, of]), np.concatenate([member, near])
            ip, done = np.concatenate([ip, new]), np.concatenate([done, np.zeros(len(of), bool)])

    def reached(self, who: np.ndarray, member: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all that edges lead to from the members that queries begin with; ``seen`` is kept up."""
        out = [(who, member)]
        while len(who):
            counts = self.offsets[member + 1] - self.offsets[member]
            near, of = self.nbrs[spread(self.offsets[member], counts)], np.repeat(who, counts)
            fresh = ~seen[of, near]
            both = np.unique(of[fresh].astype(np.int64) * self.n + near[fresh])
            who, member = both // self.n, both % self.n
            seen[who, member] = True
            out.append((who, member))
        return tuple(np.concatenate(c) for c in zip(*out))

    def scan(self, q: np.ndarray, k: int) -> Found:
        """Every product; the k best of each query."""
        ips = q @ self.x.T
        k = min(k, self.n)
        cut = np.partition(ips, self.n - k, axis=1)[:, self.n - k] if k else np.full(len(q), np.inf)
        who, member = np.nonzero(ips >= cut[:, None])
        return Found(who, member, ips[who, member], np.full(len(q), self.n))

    def best(self, found: Found, k: int) -> Found:
        order = np.lexsort((self.ids[found.member], -found.ip, found.query))
        order = order[first_of(found.query[order], k)]
        return Found(found.query[order], found.member[order], found.ip[order], found.cost)

    def block(self) -> int:
        return max(1, min(BLOCK, SEEN_BYTES // max(1, self.n)))


def trimmed(src: np.ndarray, dst: np.ndarray, ip: np.ndarray, ids: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each source the ``most`` best edges, each once, ties by the target's id, in order of source."""
    _, at = np.unique(src.astype(np.int64) * n + dst, return_index=True)
    src, dst, ip = src[at], dst[at], ip[at]
    order = np.lexsort((ids[dst], -ip, src))
    order = order[first_of(src[order], most)]
    return src[order], dst[order], ip[order]


def band(x: np.ndarray, orders: list[np.ndarray], width: int, directed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between members at most ``width`` places apart in one of the orders; directed: from the larger position to the smaller."""
    a = np.concatenate([o[d:] for o in orders for d in range(1, min(width, len(x) - 1) + 1)] or [np.zeros(0, np.int64)])
    b = np.concatenate([o[: len(o) - d] for o in orders for d in range(1, min(width, len(x) - 1) + 1)] or [np.zeros(0, np.int64)])
    both = np.unique(np.maximum(a, b).astype(np.int64) * len(x) + np.minimum(a, b))
    src, dst = both // len(x), both % len(x)
    ip = np.concatenate([np.einsum("ij,ij->i", x[src[i : i + 65536]], x[dst[i : i + 65536]]) for i in range(0, len(src), 65536)] or [np.zeros(0)])
    return (src, dst, ip) if directed else (np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([ip, ip]))


@dataclass(frozen=True)
class GraphParams:
    """How a shard's graph is made: see :func:`build_shard`."""

    build_min: int = 256
    width: int = 10
    degree: int = 24
    max_degree: int = 48
    rounds: int = 1
    ef: int = 80
    step: int = 8


def build_shard(ids: np.ndarray, x: np.ndarray, proj: np.ndarray, tables: int, bits: int, p: GraphParams) -> Shard:
    """A shard of vectors in any order, with its graph.

    With ``build_min`` members or more the graph begins with bands of
    ``width`` in the order of each hash table, from smaller norms to larger;
    then in each of ``rounds`` every member searches the graph of the round
    before, both ways, best first with a pool of ``ef``, and keeps its
    ``degree`` best; these and their reverses, ``max_degree`` of a member at
    most, are the next graph.  Smaller shards are bands of the square root of
    their size in the order of norms.
    """
    sq = np.array([float(s) for s in np.einsum("ij,ij->i", x, x)]) if len(x) else np.zeros(0)
    order = np.lexsort((ids, -sq))
    ids, x, norms = ids[order], np.ascontiguousarray(x[order]), np.sqrt(sq[order])
    words = pack(x, proj, tables, bits)
    n = len(ids)
    if n < p.build_min:
        src, dst, ip = band(x, [np.arange(n)], int(np.floor(np.sqrt(n))), directed=False)
        src, dst, _ = trimmed(src, dst, ip, ids, n, p.max_degree)
        return Shard(ids, norms, words, *csr(n, src, dst), x)
    src, dst, ip = band(x, [np.argsort(words[:, t], kind="stable") for t in range(tables)], p.width, directed=True)
    src, dst, ip = trimmed(src, dst, ip, ids, n, p.max_degree)
    for _ in range(p.rounds):
        src, dst, ip = trimmed(np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([ip, ip]), ids, n, p.max_degree)
        g = Shard(ids, norms, words, *csr(n, src, dst), x)
        kept = []
        for at in range(0, n, g.block()):
            own = np.arange(at, min(n, at + g.block()))
            f = g.best(g.walk(x[own], None, [g.nbrs[g.offsets[i] : g.offsets[i + 1]] for i in own], p.degree, p.ef - p.degree, step=p.step, skip=own), p.degree)
            kept.append((own[f.query], f.member, f.ip))
        src, dst, ip = (np.concatenate(c) for c in zip(*kept))
        src, dst, ip = trimmed(np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([ip, ip]), ids, n, p.max_degree)
    return Shard(ids, norms, words, *csr(n, src, dst), x)
