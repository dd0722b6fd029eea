"""Token counts of a byte-fallback piece model by rank-synchronous array merging.

Texts are cut into pre-tokens at places no piece spans, and each distinct pre-token of a batch is counted once:
all of them lie end to end in one numpy array of symbol ids. A round looks up the rank of every adjacent pair,
takes each sequence's lowest, and merges its occurrences in all sequences at once, until nothing merges.
The surviving symbols are the tokens; a character outside the vocabulary counts as its UTF-8 bytes.

The library merges one pair at a time, the leftmost of the lowest rank. A round equals that as long as no merge makes
a pair of better rank, since that one would come before the other occurrences; so a sequence takes its occurrences up
to the first that does. Pieces of equal rank are runs of one character (spaces) of any length up to the longest such
piece: the library then takes the longest from the left, and a run's count is how often that fits and its rest's count.

A round costs the length of what is alive. Sequences of more than ``LONG`` symbols stay in rounds only while each takes
a sixteenth of them away (the first ``ROUNDS`` are free); then a heap of (rank, place) goes on from where the rounds stopped, so long texts without
a break take near-linear time.

Defined cases: null and empty texts have no tokens; control strings inside texts are ordinary text; nothing is
truncated; texts of any length are handled, memory is that of an Arrow batch plus a bounded cache of pre-tokens;
repeated rows are counted each; an empty table gives none; extra columns pass through, but for one named as ``out``,
which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import table

#: Pre-tokens whose counts a worker remembers, and the longest text that is remembered.
CACHE, CACHE_CHARS = 400_000, 40
#: Symbols of a sequence from which each round after the first ``ROUNDS`` must take a sixteenth of them, or the heap goes on.
LONG, ROUNDS = 64, 16
_SPACE = "▁"
_NONE = np.iinfo(np.int32).max


def load(path: str) -> dict:
    """Arrays of a sentencepiece BPE model without normalisation rules; what the counter needs of it."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
        raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
    scores = {p.piece: p.score for p in model.pieces if p.type == 1}
    ids = {p: i for i, p in enumerate(scores)}
    real = len(ids)
    for p in scores:
        for c in p:
            ids.setdefault(c, len(ids))
    levels = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
    rank = np.array([levels[s] for s in scores.values()] + [_NONE] * (len(ids) - real), np.int32)
    pairs = {}
    for p in scores:
        for i in range(1, len(p)):
            if p[:i] in ids and p[i:] in ids:
                pairs[ids[p[:i]] * len(ids) + ids[p[i:]]] = ids[p]
    keys = np.array(sorted(pairs), np.int64)
    made = np.array([pairs[k] for k in keys.tolist()], np.int32)
    # Pieces of equal rank: only multiples of one character.
    level = np.bincount(rank[:real])[rank[:real]] > 1
    tied = [p for p, x in zip(scores, level, strict=True) if x]
    run, most = tied[0][0] if tied else "", max(map(len, tied), default=0)
    if any(p.strip(run) for p in tied) or len({scores[p] for p in tied}) > 1 or any(run * 2 in p and p not in tied for p in scores if run):
        raise ValueError("only runs of one character may share a score")
    chars = {ord(p): i for p, i in ids.items() if len(p) == 1}
    inner = sorted({(ord(a) << 21) | ord(b) for p in scores for a, b in zip(p, p[1:], strict=False)})
    spans = any(_SPACE in p.lstrip(_SPACE) for p in scores)
    return {
        "n": len(ids), "real": real, "rank": rank, "keys": keys, "made": made, "run": ids.get(run, -1), "most": most, "tied": int(rank[ids[tied[0]]]) if tied else -1, "inner": np.array(inner, np.int64),
        "points": np.array(list(chars), np.int64), "point_ids": np.array(list(chars.values()), np.int32), "prefix": bool(spec.add_dummy_prefix), "spans": spans, "breaks": not any("\n" in p for p in scores),
    }


class Counter:
    """Counts tokens of texts with the arrays of ``load``."""

    def __init__(self, model: dict):
        self.m = model
        at = np.arange(0x110000)
        self.char = np.where(at < 0x80, -1, np.where(at < 0x800, -2, np.where(at < 0x10000, -3, -4))).astype(np.int32)
        # A character that only occurs inside pieces has an id but is no token of its own.
        self.bytes_of = -self.char
        self.char[model["points"]] = model["point_ids"]
        self.weight = np.ones(model["n"], np.int64)
        own = model["point_ids"] >= model["real"]
        self.weight[model["point_ids"][own]] = self.bytes_of[model["points"][own]]
        self.cache: dict[str, int] = {}
        self.table: dict[int, int] | None = None  # of the heap, made when first needed
        self.rest: np.ndarray | None = None  # tokens of the tied character's runs, by length
        self.split = (lambda t: [t]) if model["spans"] else re.compile(r" +[^ \n]*|[^ \n]+|\n" if model["breaks"] else r" +[^ ]*|[^ ]+").findall

    def pieces(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        keys = self.m["keys"]
        key = left.astype(np.int64) * self.m["n"] + right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (left >= 0) & (right >= 0), self.m["made"][at], -1)

    def ranks(self, pieces: np.ndarray) -> np.ndarray:
        return np.where(pieces >= 0, self.m["rank"][np.maximum(pieces, 0)], _NONE)

    def worth(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens that each surviving symbol stands for."""
        return np.where(symbols < 0, -symbols.astype(np.int64), self.weight[np.maximum(symbols, 0)])

    def merged(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        m = self.m
        points = np.frombuffer("".join(words).replace(" ", _SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        s = self.char[points]
        counts = np.zeros(len(words), np.int64)
        # A new sequence begins at each pre-token and wherever no piece holds the two characters side by side.
        begin = np.ones(len(s), bool)
        if len(s) > 1:
            pair = (points[:-1] << 21) | points[1:]
            begin[1:] = (word[1:] != word[:-1]) | (m["inner"][np.minimum(np.searchsorted(m["inner"], pair), len(m["inner"]) - 1)] != pair)
        rounds = 0
        while len(s):
            rounds += 1
            target = np.full(len(s), -1, np.int32)  # of each symbol with the next
            target[:-1] = np.where(begin[1:], -1, self.pieces(s[:-1], s[1:]))
            rank = self.ranks(target)
            starts = np.flatnonzero(begin)
            size = np.diff(np.append(starts, len(s)))
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == _NONE
            last = lowest == m["tied"]
            if last.any():
                counts += self._runs(s, word, begin, rank == m["tied"], np.repeat(last, size), len(words))
            if over.any():
                done = np.repeat(over, size)
                np.add.at(counts, word[done], self.worth(s[done]))
            live = ~(over | last)
            if not live.all():
                stay = np.repeat(live, size)
                s, word, begin, rank, target = s[stay], word[stay], begin[stay], rank[stay], target[stay]
                size, lowest = size[live], lowest[live]
                if not len(s):
                    break
            seq = np.repeat(np.arange(len(size)), size)
            chosen = np.flatnonzero(rank == lowest[seq])
            own = seq[chosen]
            # Of overlapping occurrences every second one is merged, from the left.
            apart = np.ones(len(chosen), bool)
            apart[1:] = chosen[1:] != chosen[:-1] + 1
            first = np.maximum.accumulate(np.where(apart, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            own, into = seq[chosen], target[chosen]
            # What a merge would pair with: to the left as already merged, to the right as yet unmerged.
            left = np.where(begin[chosen], -1, s[chosen - 1])
            close = np.flatnonzero((chosen[1:] == chosen[:-1] + 2) & (own[1:] == own[:-1])) + 1
            left[close] = into[close - 1]
            after = np.minimum(chosen + 2, len(s) - 1)
            right = np.where((chosen + 2 < len(s)) & ~begin[after], s[after], -1)
            better = np.minimum(self.ranks(self.pieces(left, into)), self.ranks(self.pieces(into, right))) < lowest[own]
            before = np.cumsum(better) - better
            heads = np.ones(len(own), bool)
            heads[1:] = own[1:] != own[:-1]
            take = before == np.maximum.accumulate(np.where(heads, before, 0))
            chosen, own, into = chosen[take], own[take], into[take]
            slow = (size > LONG) & (rounds > ROUNDS) & (np.bincount(own, minlength=len(size)) * 16 < size)
            s[chosen] = into
            stay = np.ones(len(s), bool)
            stay[chosen + 1] = False
            if slow.any():
                for k in np.flatnonzero(slow):
                    lo, hi = np.searchsorted(seq, [k, k + 1])
                    counts[word[lo]] += self._heaped(s[lo:hi][stay[lo:hi]])
                    stay[lo:hi] = False
            s, word, begin = s[stay], word[stay], begin[stay]
        return counts

    def _runs(self, s: np.ndarray, word: np.ndarray, begin: np.ndarray, tied: np.ndarray, mine: np.ndarray, n: int) -> np.ndarray:
        """Tokens by word of the sequences of which only runs of the tied character are left to merge."""
        out = np.zeros(n, np.int64)
        tail = np.zeros(len(s), bool)  # second and later characters of a run
        tail[1:] = tied[:-1] & mine[1:] & ~begin[1:]
        head = mine & ~tail
        head[:-1] &= tail[1:]
        head[-1] = False
        alone = mine & ~tail & ~head
        np.add.at(out, word[alone], self.worth(s[alone]))
        at = np.flatnonzero(head)
        inside = np.flatnonzero(tail)
        length = 1 + np.bincount(np.searchsorted(at, inside, side="right") - 1, minlength=len(at)) if len(at) else np.zeros(0, np.int64)
        most = self.m["most"]
        if self.rest is None:
            self.rest = np.array([0, *(self._heaped(np.full(k, self.m["run"], np.int32)) for k in range(1, 2 * most))])
            if (self.rest[most:] != self.rest[:most] + 1).any():
                raise ValueError("a run is not its longest pieces and a rest")
        np.add.at(out, word[at], length // most + self.rest[length % most])
        return out

    def _heaped(self, symbols: np.ndarray) -> int:
        """Tokens of one sequence, merged in the library's order from a heap of rank and place."""
        m, n = self.m, len(symbols)
        if self.table is None:
            self.table = dict(zip(m["keys"].tolist(), m["made"].tolist(), strict=True))
            self.rank_of = m["rank"].tolist()
        table, rank_of, base = self.table, self.rank_of, m["n"]
        s = symbols.tolist()
        into = self.pieces(symbols[:-1], symbols[1:])
        rank = self.ranks(into).astype(np.int64)
        found = np.flatnonzero(into >= 0)
        heap = (rank[found] * (n + 1) + found).tolist()
        heapify(heap)
        # The piece that a symbol and the next would make now, or -1; neighbours by place, with ends at n and -1.
        target = [*into.tolist(), -1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, at = divmod(heappop(heap), n + 1)
            piece = target[at]
            if piece < 0 or rank_of[piece] != r:
                continue
            gone = after[at]
            s[at] = piece
            right = after[at] = after[gone]
            target[gone] = target[at] = -1
            s[gone] = None
            if right < n:
                before[right] = at
                b = s[right]
                made = table.get(piece * base + b, -1) if b >= 0 else -1
                if made >= 0:
                    target[at] = made
                    heappush(heap, rank_of[made] * (n + 1) + at)
            left = before[at]
            if left >= 0:
                a = s[left]
                made = table.get(a * base + piece, -1) if a >= 0 else -1
                target[left] = made
                if made >= 0:
                    heappush(heap, rank_of[made] * (n + 1) + left)
        return int(self.worth(np.array([x for x in s if x is not None], np.int64)).sum())

    def count(self, texts: list) -> list[int]:
        lead = " " if self.m["prefix"] else ""
        cut = [self.split(lead + t.replace(_SPACE, " ")) if t else [] for t in texts]
        new = set()
        for words in cut:
            new.update(words)
        new -= self.cache.keys()
        fresh = list(new)
        known = self.cache
        if fresh:
            found = dict(zip(fresh, self.merged(fresh).tolist(), strict=True))
            short = {w: n for w, n in found.items() if len(w) <= CACHE_CHARS}
            if len(known) + len(short) > CACHE:
                counts = known | found
                self.cache = short if len(short) <= CACHE else {}
            else:
                known |= short
                counts = known if len(short) == len(found) else known | found
        else:
            counts = known
        return [sum(map(counts.__getitem__, words)) for words in cut]


def add_counts(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of ``text`` under the model at ``path`` (read on the driver)."""
    model = df.sparkSession.sparkContext.broadcast(load(path))  # some hundred kB, set by the vocabulary

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(model.value)
        for texts in batches:
            # Blocks of some MB, so that a batch of very long texts isn't cut into words all at once.
            values, block, size, found = texts.tolist(), [], 0, []
            for t in values:
                block.append(t)
                size += len(t or "")
                if size > 4_000_000:
                    found += counter.count(block)
                    block, size = [], 0
            yield pd.Series(found + counter.count(block), dtype="int64")

    return df.withColumn(out, tokens(F.col(text)))


def op10_token_counts(spark, sf_dir, model: str | None = None, limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = add_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
