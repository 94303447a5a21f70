"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import GOLDEN, mix, pick, remembered, uniforms

# Sampled segmentations per text; how sharply they follow the piece weights.
SAMPLES, SHARPNESS = 2, 1.0
# Characters of text sampled side by side.
SLICE = 2_000_000
_BASE, _BACK = int(GOLDEN), pow(int(GOLDEN), -1, 1 << 64)


class Vocabulary:
    """Pieces of a SentencePiece model with a log weight each.

    A unigram model's scores are log-probabilities (``prior="score"``). A BPE model's scores are only ranks; its
    pieces then weigh by Zipf's law, ``1 / (rank + 2)`` (``prior="rank"``). ``sharpness`` multiplies log weights. A character
    that is no piece is written as its UTF-8 bytes, each as rare as the last piece.
    """

    def __init__(self, path: str, prior: str = "rank", sharpness: float = SHARPNESS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        scores = {i: self.model.get_score(i) for i in normal}
        if prior == "rank":
            ranked = sorted(normal, key=lambda i: (-scores[i], i))
            scores = {i: -math.log(rank + 2.0) for rank, i in enumerate(ranked)}
        hashes, beginnings = [], []
        for i in normal:
            total, _ = prefix_sums(np.frombuffer(names[i].encode("utf-32-le"), dtype="<u4"))
            hashes.append(total[-1])
            beginnings.append(total[1:-1])
        order = np.argsort(np.array(hashes, dtype=np.uint64), kind="stable")
        self.hashes = np.array(hashes, dtype=np.uint64)[order]
        self.id = np.array(normal)[order]
        self.weight = np.exp(sharpness * np.array([scores[i] for i in normal]))[order]
        # Where the hashes of equal leading bits begin, -1 for none; how many follow each other at most.
        leading = (self.hashes >> np.uint64(44)).astype(np.int64)
        filled, begin, sizes = np.unique(leading, return_index=True, return_counts=True)
        # Whether a piece has such a hash (1), and whether the beginning of a longer one has (2).
        self.filter, self.begin, self.crowd = np.zeros(1 << 20, dtype=np.uint8), np.full(1 << 20, -1, dtype=np.int32), int(sizes.max(initial=0))
        self.filter[filled], self.begin[filled] = 1, begin
        self.filter[np.unique(np.concatenate([*beginnings, np.zeros(0, np.uint64)]) >> np.uint64(44)).astype(np.int64)] |= 2
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = self.model.unk_id()
        self.byte_weight = float(self.weight.min())
        self.longest = max(len(names[i]) for i in normal)
        self.runs = self._run_pattern([names[i] for i in normal])

    @staticmethod
    def _run_pattern(pieces: list[str]) -> re.Pattern:
        """How to cut a text where no piece can cross.

        Words begin with their marks; a line break stands alone unless a piece holds one; marks of punctuation part from
        other characters if no piece joins them. A vocabulary whose pieces run over word marks is not cut.
        """
        if any("▁" in p.lstrip("▁") for p in pieces):
            return re.compile("(?s).+")
        apart = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        while True:
            mixed = {c for p in pieces for a, b in zip(p, p[1:]) if "▁" not in (a, b) and (a in apart) != (b in apart) for c in (a, b) if c in apart}
            if not mixed:
                break
            apart -= mixed
        own = re.escape("".join(sorted(apart)))
        line = "" if any("\n" in p for p in pieces) else "\n"
        parts = [f"▁*[^▁{line}{own}]+", *([f"▁*[{own}]+"] if own else []), "▁+", *([line] if line else [])]
        return re.compile("|".join(parts))

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that is no piece: its bytes, or the unknown piece where the model has no bytes."""
        ids = [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if self.unknown in ids else ids

    def split(self, text: str) -> list[str]:
        return self.runs.findall(self.model.normalize(text))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the pieces, -1 for none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        leading = (hashes >> np.uint64(44)).view(np.int64)
        maybe = np.flatnonzero(self.filter[leading] & 1)
        at, wanted = self.begin[leading[maybe]], hashes[maybe]
        for _ in range(self.crowd):
            hit = self.hashes[at] == wanted
            out[maybe[hit]] = at[hit]
            rest = np.flatnonzero(~hit & (at + 1 < len(self.hashes)))
            if not len(rest):
                break
            maybe, wanted, at = maybe[rest], wanted[rest], at[rest] + 1
        return out


def vocabulary(path: str, prior: str, sharpness: float) -> Vocabulary:
    """The worker's vocabulary."""
    return remembered(("pieces", path, prior, sharpness), lambda: Vocabulary(path, prior, sharpness))


def prefix_sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix sums of code points, and the factors that move a difference to the start."""
    with np.errstate(over="ignore"):
        forth = np.full(len(points) + 1, _BASE, dtype=np.uint64)
        back = np.full(len(points) + 1, _BACK, dtype=np.uint64)
        forth[0] = back[0] = 1
        forth, back = np.multiply.accumulate(forth), np.multiply.accumulate(back)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64)) * forth[:-1])]), back


def counted(flags: np.ndarray) -> np.ndarray:
    """How many flags of each row hold."""
    if flags.shape[1] % 8:
        return flags.sum(axis=1)
    words = np.bitwise_count(flags.view(np.uint64)).astype(np.int64)
    return words.sum(axis=1) if words.shape[1] > 2 else words[:, 0] + words[:, -1] * (words.shape[1] - 1)


class Lattices:
    """The lattices of the distinct runs of some texts side by side.

    A node is a position in a run, its end included; positions with the same characters up to the end are one node. Edge
    ``node * wide + length - 1`` leads ``length`` characters on, to ``on[node, length - 1]``. Its probability is conditional: weight
    of all ways on through it over weight of all ways on from the node. Those sums run from the ends to the starts of all runs at
    once and are rescaled on the way, so runs of any length are safe.
    """

    def __init__(self, vocabulary_: Vocabulary, runs: list[str]):
        self.vocabulary = vocabulary_
        # The distinct runs, the longest first, and which of them each run is.
        which, found = pd.factorize(np.array([*runs, None], dtype=object)[:-1])
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        order = np.argsort(-lengths, kind="stable")
        distinct, lengths = found[order].tolist(), lengths[order]
        longest, wide = int(lengths.max(initial=0)), vocabulary_.longest
        self.wide = wide
        points = np.frombuffer("\0".join([*distinct, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        stop = np.cumsum(lengths + 1) - 1
        # Nodes are numbered by their distance to the run's end, so that everything at one distance lies together.
        reach = np.searchsorted(-lengths, -np.arange(longest + 1), side="right")  # runs of at least that length
        at, ends, next_, places = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64), [], []
        level = [0, min(1, len(distinct))]
        if len(distinct):
            next_.append(np.zeros(1, dtype=np.int64)), places.append(stop[:1])
        for d in range(1, longest + 1):
            here = at[: reach[d]]
            same, keys = pd.factorize(here << 21 | points[stop[: reach[d]] - d])
            one = np.zeros(len(keys), dtype=np.int64)
            one[same[::-1]] = np.arange(len(same))[::-1]  # where each stands first
            next_.append(here[one]), places.append(stop[one] - d)
            here[:] = level[d] + same
            level.append(level[d] + len(one))
            ends[reach[d + 1] if d < longest else 0 : reach[d]] = here[reach[d + 1] if d < longest else 0 :]
        self.level = np.array(level)
        n = level[-1]
        self.left = np.repeat(np.arange(longest + 1), np.diff(self.level[: longest + 2]))
        self._begin = distinct, ends
        placed = np.zeros(len(distinct), dtype=np.int64)
        placed[order] = ends
        self.starts = placed[which]  # the node each run starts at
        place = np.concatenate([*places, np.zeros(0, dtype=np.int64)])  # of each node in ``points``
        self.points = points[place]
        self.on = np.zeros((n, wide), dtype=np.int32)
        for d in range(1, longest + 1):
            here = slice(level[d], level[d + 1])
            self.on[here, 0] = next_[d]
            self.on[here, 1:] = self.on[next_[d], :-1]
        total, back = prefix_sums(points)
        self.p = np.zeros((n, wide))
        self.piece = np.full((n, wide), -1, dtype=np.int32)
        # Nodes from which a piece of that length or a longer one may go on.
        going = np.arange(int(self.level[1]), n)
        at = place[going]
        start, back = total[at], back[at]
        for size in range(1, min(wide, longest) + 1):
            with np.errstate(over="ignore"):
                hashes = (total[at + size] - start) * back
            flags = vocabulary_.filter[(hashes >> np.uint64(44)).view(np.int64)]
            maybe = np.flatnonzero(flags & 1)
            hit = vocabulary_.find(hashes[maybe])
            good = np.flatnonzero(hit >= 0)
            edges = going[maybe[good]] * wide + (size - 1)
            self.p.ravel()[edges], self.piece.ravel()[edges] = vocabulary_.weight[hit[good]], vocabulary_.id[hit[good]]
            if size < longest:
                more = np.flatnonzero((flags & 2).astype(bool) & (going >= self.level[size + 1]))
                going, at, start, back = going[more], at[more], start[more], back[more]
        # A character that is no piece is written as bytes.
        raw = np.flatnonzero((self.piece[:, 0] < 0) & (self.left > 0))
        size = 1 + (self.points[raw] >= 0x80) + (self.points[raw] >= 0x800) + (self.points[raw] >= 0x10000)
        self.p[raw, 0] = vocabulary_.byte_weight ** size.astype(float)
        # A node's ways on are ``ways * 1e-150 ** scale``.
        ways, scale = np.ones(n), np.zeros(n, dtype=np.int64)
        # As many columns as whole 64-bit words of flags; what is beyond the last length is above every draw.
        self.cdf = np.full((n, -(-wide // 8) * 8), 2.0, dtype=np.float32)
        for d in range(1, longest + 1):
            at, m = level[d], level[d + 1] - level[d]
            # One length after the other, each a row of its own.
            here = np.ascontiguousarray(self.p[at : at + m, : min(d, wide)].T)
            on = np.ascontiguousarray(self.on[at : at + m, : len(here)].T)
            base = 0
            if scale[level[max(0, d - wide)] : at].any():
                lower = np.where(here > 0, scale[on], np.iinfo(np.int64).max)
                base = lower.min(axis=0)
                here *= 1e-150 ** np.minimum(lower - base, 3).astype(float)
            sum_ = np.zeros(m)
            for to, row in zip(on, here):
                row *= ways[to]
                sum_ += row
            here /= sum_
            self.p[at : at + m, : len(here)] = here.T
            ways[at : at + m] = sum_
            shares = here.astype(np.float32)
            for i in range(1, len(shares)):
                shares[i] += shares[i - 1]
            self.cdf[at : at + m, : len(shares)] = shares.T
            self.cdf[at : at + m, len(shares) : wide] = shares[-1][:, None]
            low = sum_ < 1e-150
            if low.any() or np.any(base):
                scale[at : at + m] = base + low
                ways[at : at + m][low] *= 1e150
        self.choices = counted(self.p > 0).astype(np.int32)

    @cached_property
    def first(self) -> dict[str, int]:
        """The node each distinct run starts at."""
        return dict(zip(self._begin[0], self._begin[1].tolist()))

    def draw(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one random path per start node to its run's end: path number and edge, in order."""
        owner, node, step = np.arange(len(nodes)), nodes, 0
        steps = []
        while True:
            going = node > 0  # the one node at the end of all runs
            if not going.all():
                owner, node = owner[going], node[going]
            if not len(node):
                break
            with np.errstate(over="ignore"):
                u = uniforms(mix(seeds[owner] + np.uint64(step) * GOLDEN))
            size = counted(np.take(self.cdf, node, axis=0) <= u[:, None].astype(np.float32))
            over = np.flatnonzero(size >= self.wide)
            for i in over:  # the sum of the shares fell short of u by rounding
                size[i] = np.flatnonzero(self.p[node[i]])[-1]
            edge = node * self.wide + size
            steps.append((owner, edge))
            node, step = self.on.ravel()[edge], step + 1
        # A path's edges follow each other, and none of its steps is left out.
        long = np.zeros(len(nodes), dtype=np.int64)
        for step, (owner, _) in enumerate(steps, 1):
            long[owner] = step
        begin, out = np.cumsum(long) - long, np.zeros(int(long.sum()), dtype=np.int64)
        for step, (owner, edge) in enumerate(steps):
            out[begin[owner] + step] = edge
        return np.repeat(np.arange(len(nodes)), long), out

    def log_p(self, edges: np.ndarray) -> np.ndarray:
        return np.log(self.p.ravel()[edges])

    def after(self, node: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The node ``size`` characters on."""
        return self.on[node, size - 1]

    def ends(self, edges: np.ndarray) -> np.ndarray:
        return self.after(edges // self.wide, edges % self.wide + 1)

    def packed(self, paths: list[np.ndarray]) -> list[bytes]:
        """Ids of each path as little-endian 32-bit numbers."""
        edges = np.concatenate([*paths, np.zeros(0, dtype=np.int64)])
        ids = self.piece.ravel()[edges]
        raw = np.flatnonzero(ids < 0)
        chars, which = np.unique(self.points[edges[raw] // self.wide], return_inverse=True)
        spelled = [self.vocabulary.spelled(chr(c)) for c in chars.tolist()]
        sizes = np.array([len(s) for s in spelled], dtype=np.int64)[which]
        # Where each edge's ids begin.
        room = np.ones(len(ids) + 1, dtype=np.int64)
        room[raw] = sizes
        begin = np.cumsum(room) - room
        out = np.repeat(ids.astype("<u4"), room[:-1])
        for i in range(int(sizes.max(initial=0))):
            own = np.flatnonzero(sizes > i)
            out[begin[raw[own]] + i] = np.array([s[i] if i < len(s) else 0 for s in spelled], dtype="<u4")[which[own]]
        stops = begin[np.cumsum([0, *map(len, paths)])].tolist()
        return [out[a:b].tobytes() for a, b in zip(stops, stops[1:])]


def gumbel_below(mass: np.ndarray, u: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Gumbel variables with location ``mass`` (a log), truncated at a bound, given as ``below``, the exponential of its negative; -inf where there is no mass."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = -np.log(below - np.log(u) / np.exp(mass))
    out[~(mass > -np.inf)] = -np.inf
    return out


def top_k(lattices: Lattices, free: list[tuple[np.ndarray, np.ndarray]], first: np.ndarray, k: int, seeds: np.ndarray) -> list[list[tuple]]:
    """For each text up to ``k`` distinct segmentations in the order of their perturbed log-probabilities: ``(edges, log p, perturbed, inclusion)``.

    A* search from the top: the set of all segmentations has the largest perturbed value of all, and the path drawn
    first bears it. What is left falls into one set for every edge of that path, the paths that agree before the edge and not
    at it; each gets a Gumbel variable of its own mass truncated at the set's, and the set with the largest gives the next
    path. The largest value then left is the threshold ``kappa``: a segmentation belongs to such a sample with
    probability ``1 - exp(-exp(log p - kappa))`` (1 if none is left).

    ``free`` holds ``k`` independent paths through all runs of all texts, as run numbers and edges; text ``i`` has the runs
    ``first[i]`` to ``first[i + 1]``. The texts advance together, one round per sample.
    """
    n = len(first) - 1
    with np.errstate(over="ignore"):
        own = [mix(seeds + np.uint64(j) * GOLDEN) for j in range(2 * k + 1)]
    bound = -np.log(-np.log(uniforms(own[2 * k])))
    cuts = [np.searchsorted(runs, first) for runs, _ in free]
    runs = [free[0][0][cuts[0][i] : cuts[0][i + 1]] for i in range(n)]
    paths = [free[0][1][cuts[0][i] : cuts[0][i + 1]] for i in range(n)]
    from_, barred = np.zeros(n, dtype=np.int64), [()] * n
    out: list[list[tuple]] = [[] for _ in range(n)]
    rounds: list[tuple] = []  # of each round: values of the sets, where each text's begin, paths, runs, excluded edges
    live = np.array([len(p) > 0 for p in paths])
    for i in np.flatnonzero(~live):
        out[i].append((paths[i], 0.0, float(bound[i])))
        bound[i] = -np.inf
    for number in range(k):
        sizes = np.array([len(p) if on else 0 for p, on in zip(paths, live)], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.concatenate([p for p, on in zip(paths, live) if on] or [np.zeros(0, dtype=np.int64)])
        text = np.repeat(np.arange(n), sizes)
        position = np.arange(len(edges)) - np.repeat(begin[:-1], sizes)
        p = lattices.p.ravel()[edges]
        logp = np.log(p)
        total = np.concatenate([[0.0], np.cumsum(logp)])
        before = total[:-1] - np.repeat(total[begin[:-1]], sizes)
        gone, used = p.copy(), np.ones(len(p), dtype=np.int64)
        for i in np.flatnonzero(live):
            out[i].append((paths[i], float(total[begin[i + 1]] - total[begin[i]]), float(bound[i])))
            if len(barred[i]):
                gone[begin[i] + from_[i]] += lattices.p.ravel()[list(barred[i])].sum()
                used[begin[i] + from_[i]] += len(barred[i])
        # An edge without alternative leaves nothing, whatever rounding makes of it; nor do edges of the set's fixed beginning.
        some = np.flatnonzero((used < lattices.choices[edges // lattices.wide]) & (position >= from_[text]))
        with np.errstate(divide="ignore", over="ignore"):
            mass, below = before[some] + np.log(np.maximum(0.0, 1.0 - gone[some])), np.exp(-bound)
        mixed = mix(np.arange(int(sizes.max(initial=0))).astype(np.uint64))
        values, of = np.full(len(edges), -np.inf), text[some]
        values[some] = gumbel_below(mass, uniforms(mix(own[number][of] ^ mixed[position[some]])), below[of])
        rounds.append((values, begin, paths, runs, from_.copy(), barred))
        best = np.full((number + 1, n), -np.inf)
        for j, (v, b, *_) in enumerate(rounds):
            has = np.flatnonzero(b[1:] > b[:-1])
            if len(has):
                best[j, has] = np.maximum.reduceat(v, b[has])
        chosen = best.argmax(axis=0)
        bound = np.where(live, best.max(axis=0), -np.inf)
        live = live & (bound > -np.inf)
        if number + 1 == k or not live.any():
            break
        paths, runs, barred = [()] * n, [()] * n, [()] * n
        picks = uniforms(own[k + number])
        starts, rest_seed, todo = [], [], np.flatnonzero(live)
        for i in todo:
            v, b, old, _, old_from, old_barred = rounds[chosen[i]]
            at = int(v[b[i] : b[i + 1]].argmax())
            v[b[i] + at] = -np.inf
            taken = (int(old[i][at]), *(old_barred[i] if at == old_from[i] else ()))
            here = taken[0] // lattices.wide
            shares = lattices.p[here].copy()
            shares[[e % lattices.wide for e in taken]] = 0.0
            summed = np.cumsum(shares)
            size = min(int(np.searchsorted(summed, picks[i] * summed[-1], side="right")), int(np.flatnonzero(shares)[-1]))
            from_[i], barred[i] = at, taken
            starts.append(int(lattices.after(np.array([here]), np.array([size + 1]))[0])), paths.__setitem__(i, here * lattices.wide + size)
        # On to the end of this run by a draw of its own; the runs after it are free.
        owner, rest = lattices.draw(np.array(starts, dtype=np.int64), own[k + number][todo] ^ GOLDEN)
        stops = np.searchsorted(owner, np.arange(len(todo) + 1))
        next_runs, next_edges = free[number + 1]
        for j, i in enumerate(todo):
            _, _, old, old_runs, _, _ = rounds[chosen[i]]
            at, more = from_[i], rest[stops[j] : stops[j + 1]]
            run = old_runs[i][at]
            tail, end = int(np.searchsorted(next_runs, run + 1)), cuts[number + 1][i + 1]
            edge = paths[i]
            paths[i] = np.concatenate([old[i][:at], [edge], more, next_edges[tail:end]])
            runs[i] = np.concatenate([old_runs[i][:at], np.full(1 + len(more), run), next_runs[tail:end]])
    return [
        [(e, l, g, 1.0 if b == -np.inf else float(-np.expm1(-np.exp(min(700.0, l - b))))) for e, l, g in own_] for own_, b in zip(out, bound.tolist())
    ]


def segmentations(
    docs: DataFrame, k: int = SAMPLES, key: str = "doc_id", text: str = "text", path: str | None = None,
    prior: str = "rank", sharpness: float = SHARPNESS, seed: int = 0,
) -> DataFrame:
    """``key, sample, ids, n_pieces, log_prob, perturbed, inclusion``: up to ``k`` distinct segmentations of each text.

    They are drawn without replacement in proportion to the product of their pieces' weights, by the Gumbel-top-k
    trick; ``sample`` counts from 1 in the order of ``perturbed`` values, ``inclusion`` is the probability that the segmentation
    belongs to such a sample given its threshold (Horvitz-Thompson weights are its inverse). ``ids`` are
    little-endian unsigned 32-bit numbers.

    Randomness comes from ``seed``, the key and the position in the text alone, so results do not depend on partitions;
    rows that repeat a key and a text repeat its samples. A null or empty text has one segmentation, of no
    pieces, with log-probability 0 and inclusion 1; so has every text with fewer than ``k`` fewer samples. Whole
    texts are sampled, a slice of ``SLICE`` characters of the corpus at a time.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pick(docs, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, sample int, ids binary, n_pieces bigint, log_prob double, perturbed double, inclusion double"

    def sampled(names: list, texts: list[str | None]) -> list[tuple]:
        voc = vocabulary(path, prior, sharpness)
        split = [voc.split(t) if t else [] for t in texts]
        every = [r for s in split for r in s]
        lattices = Lattices(voc, every)
        seeds = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{n}".encode()) for n in names], dtype=np.uint64)
        counts = np.array([len(s) for s in split], dtype=np.int64)
        nodes = lattices.starts
        first = np.concatenate([[0], np.cumsum(counts)])
        within = np.arange(len(every)) - np.repeat(first[:-1], counts)
        own = np.repeat(seeds, counts)
        free = [lattices.draw(nodes, mix(own ^ mix(within.astype(np.uint64) * np.uint64(k) + np.uint64(number)))) for number in range(k)]
        drawn = [(i, number, *sample) for i, samples in enumerate(top_k(lattices, free, first, k, seeds)) for number, sample in enumerate(samples, 1)]
        packed = lattices.packed([edges for _, _, edges, *_ in drawn])
        return [(i, number, data, len(data) // 4, *rest) for (i, number, _, *rest), data in zip(drawn, packed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and (stop == at or held + len(texts[stop] or "") <= SLICE):
                    held += len(texts[stop] or "")
                    stop += 1
                part = batch.slice(at, stop - at)
                columns = list(zip(*sampled(part.column("key").to_pylist(), texts[at:stop])))
                types = [pa.int32(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                arrays = [part.column("key").take(pa.array(columns[0], pa.int32())), *[pa.array(c, t) for c, t in zip(columns[1:], types)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion"])
                at = stop

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decoded(ids: str, path: str | None = None):
    """A column: the normalized text that packed ``ids`` stand for (what any segmentation of it decodes to); null stays null."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            yield batch.map(lambda b: model.decode(np.frombuffer(b, dtype="<u4").tolist()), na_action="ignore")

    return decode(F.col(ids))
