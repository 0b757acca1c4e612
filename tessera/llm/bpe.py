"""BPE encoding and decoding through a minimal acyclic transducer.

Words are counted over the whole corpus; the most frequent ones, with their ids, are compiled into
an automaton whose states share equal suffixes. Each transition carries a number, and the sum along
a word's path is its index in the table of id lists. The automaton is one file that Spark ships to
every executor, where workers map it into memory. Words it lacks are merged exactly by rank.

Null and empty texts have no ids; repeated rows are encoded one by one; other columns are ignored.
"""
import hashlib
import heapq
import os
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab
from .common import keep, whole_text

WORDS = 1 << 16          # words in the automaton: bounds the driver's work and the shipped file
WORD_BYTES = 32          # longer words are merged
LONG = 256               # bytes of a word beyond which it is merged alone
COUNTS = 1 << 17         # distinct words a task holds before it passes its partial counts on
CACHE = 1 << 18          # words a worker remembers before it starts anew


# Merging ---------------------------------------------------------------------------------------

def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: join the adjacent pair of lowest rank, leftmost first, until none is left."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 64:
        return _merge_long(word, ranks)
    never, get = len(ranks) + 1, ranks.get
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [get(word[i:i + 2], never) for i in range(len(word) - 1)]
    while pairs:
        best = min(pairs)
        if best == never:
            break
        at = pairs.index(best)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = get(parts[at - 1] + parts[at], never)
        if at < len(pairs):
            pairs[at] = get(parts[at] + parts[at + 1], never)
    return [ranks[p] for p in parts]


def merge_many(words: list[bytes], path: str) -> list[bytes]:
    """Packed ids of many words, merged side by side: in each round every word joins all places of its
    pair of lowest rank. Pairs that a join makes rank behind it, so the rounds equal single steps."""
    of_byte, keys, ids = vocab.merge_table(path)
    none = np.int64(1 << 40)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbol = of_byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    rank = np.full(len(symbol), none)              # of the pair that begins at a place
    stale = np.arange(len(symbol))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        right = np.minimum(stale + 1, len(symbol) - 1)
        key = symbol[stale] << 20 | symbol[right]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rank[stale] = np.where((keys[at] == key) & (word[stale] == word[right]) & (right > stale), ids[at], none)
        starts = np.concatenate(([0], np.nonzero(word[1:] != word[:-1])[0] + 1))
        best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
        over = best == none
        join = (rank == best) & ~over
        after = np.concatenate(([False], join[:-1]))
        if (join & after).any():                   # a pair of equal halves may overlap itself: every other place
            index = np.arange(len(join))
            join &= (index - np.maximum.accumulate(np.where(join & ~after, index, 0))) % 2 == 0
            after = np.concatenate(([False], join[:-1]))
        symbol = np.where(join, rank, symbol)
        done.append((word[over], symbol[over]))
        live = ~after & ~over
        symbol, word, rank = symbol[live], word[live], rank[live]
        new = np.nonzero(join[live])[0]            # the pairs on both sides of a join have changed
        stale = np.concatenate((new, np.maximum(new - 1, 0)))
    if not done:
        return [b""] * len(words)
    owner, symbol = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(owner, kind="stable")
    data = symbol[order].astype("<i4").tobytes()
    ends = np.cumsum(np.bincount(owner, minlength=len(words))) * 4
    return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long words, with a heap of pairs over linked parts."""
    n = len(word)
    end = list(range(1, n + 1))                  # part i is word[i:end[i]]; end is 0 once joined
    before = list(range(-1, n - 1))
    heap = [(ranks[word[i:i + 2]], i, i + 2) for i in range(n - 1) if word[i:i + 2] in ranks]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            r = ranks.get(word[i:end[end[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= n or end[end[i]] != stop:
            continue                             # one of the two has changed meanwhile
        right = end[i]
        end[i], end[right] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:end[i]]])
        i = end[i]
    return ids


# The automaton ---------------------------------------------------------------------------------

def compile_words(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """A file with the minimal automaton of distinct words and their id lists."""
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []        # final, ((byte, state), ...): replaced states are never stored

    def store(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path, last = [[False, []]], b""              # open states along the last word
    for word, _ in entries:
        same = os.path.commonprefix([word, last])
        for i in range(len(last), len(same), -1):
            path[i - 1][1].append((last[i - 1], store(path.pop())))
        path += [[False, []] for _ in word[len(same):]]
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][1].append((last[i - 1], store(path.pop())))
    root = store(path[0])

    size, keys, targets, adds = [], [], [], []   # words below each state; targets come before sources
    for s, (final, steps) in enumerate(states):
        total = int(final)
        for byte, target in steps:
            keys.append(s << 8 | byte)
            targets.append(target)
            adds.append(total)
            total += size[target]
        size.append(total)
    flat = np.fromiter(chain.from_iterable(ids for _, ids in entries), np.int32)
    bounds = np.cumsum([0, *(len(ids) for _, ids in entries)], dtype=np.int64)
    finals = np.array([f for f, _ in states], np.int64)
    parts = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(adds, np.int64), finals, bounds, flat.astype(np.int64)]
    head = np.array([root, *(len(p) for p in parts)], np.int64)
    return b"".join(p.tobytes() for p in [head, *parts])


class Automaton:
    """The compiled file, mapped into memory; looks up many words at once."""

    def __init__(self, path: str):
        data = np.asarray(np.memmap(path, np.int64, "r"))        # a plain view: slices of it cost less
        self.root, sizes, at = int(data[0]), data[1:7], 7
        parts = []
        for n in map(int, sizes):
            parts.append(data[at:at + n])
            at += n
        self.keys, self.targets, self.adds, self.finals, self.bounds, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, -1 for those that are not in the lexicon."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        fits = (lengths > 0) & (lengths <= WORD_BYTES) & np.fromiter((b"\0" not in w for w in words), bool, len(words))
        state = np.where(fits, self.root, -1)
        index = np.zeros(len(words), np.int64)
        if not len(self.keys) or not len(words):
            return np.full(len(words), -1)
        letters = np.array([w[:WORD_BYTES] for w in words], f"S{WORD_BYTES}").view(np.uint8).reshape(len(words), WORD_BYTES)
        for k in range(WORD_BYTES):
            live = np.nonzero((state >= 0) & (lengths > k))[0]
            if not len(live):
                break
            want = state[live] << 8 | letters[live, k]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            state[live] = np.where(hit, self.targets[at], -1)
            index[live] += self.adds[at] * hit
        ok = state >= 0
        ok[ok] = self.finals[state[ok]] == 1
        return np.where(ok, index, -1)

    def ids_at(self, index: int) -> list[int]:
        return self.ids[self.bounds[index]:self.bounds[index + 1]].tolist()

    def packed(self, index: np.ndarray) -> list[bytes]:
        """Packed ids at many indices."""
        begin = self.bounds[index]
        size = self.bounds[index + 1] - begin
        ends = np.cumsum(size)
        data = self.ids[np.repeat(begin - (ends - size), size) + np.arange(size.sum())].astype("<i4").tobytes()
        cuts = [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def automaton(name: str) -> Automaton:
    return Automaton(SparkFiles.get(name))


# Spark jobs ------------------------------------------------------------------------------------

def _pieces(text: str) -> list[str]:
    """Pre-tokens in order, with the special token as a piece of its own."""
    if vocab.SPECIAL not in text:
        return vocab.pretokens(text)
    parts = [vocab.pretokens(p) + [vocab.SPECIAL] for p in text.split(vocab.SPECIAL)]
    return list(chain.from_iterable(parts))[:-1]


def _counted(batches):
    from collections import Counter
    seen: Counter = Counter()
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def out():
        rows = pa.RecordBatch.from_pydict({"word": [w.encode() for w in seen], "n": list(seen.values())}, schema=schema)
        seen.clear()
        return rows

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(_pieces(text))
        if len(seen) > COUNTS:
            yield out()
    yield out()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts; tasks pass on partial counts."""
    return (docs.select(whole_text(text).alias("text")).mapInArrow(_counted, "word binary, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


def lexicon(docs: DataFrame, text: str = "text", path: str = None, words: int = WORDS) -> str:
    """Compile at most ``words`` of the most frequent words and ship the file; returns its name on executors."""
    sc = docs.sparkSession.sparkContext
    path = path or vocab.default_path()
    _, ranks, _ = vocab.load(path)
    fit = (F.octet_length("word").between(1, WORD_BYTES)) & ~F.contains(F.col("word"), F.lit(b"\0")) & (F.col("word") != F.lit(vocab.SPECIAL.encode()))
    counts = keep(word_counts(docs, text).filter(fit))
    # Words by size of their count, a few hundred rows; the lexicon ends where the next size would exceed it.
    size = F.floor(F.log2("n") * 16)
    room, least = words, None
    for r in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        if r["count"] > room:
            break
        room, least = room - r["count"], r["size"]
    top = counts.filter(size >= least).select("word").collect() if least is not None else []
    data = compile_words([(w := bytes(r.word), merge(w, ranks)) for r in top])
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:20]}.bin"
    file = os.path.join(SparkFiles.getRootDirectory(), name)       # Spark's own folder; its file server ships the copy
    if not os.path.exists(file):
        with open(f"{file}.part", "wb") as f:
            f.write(data)
        os.replace(f"{file}.part", file)
    sc.addFile(file)
    return name


class Words(dict):
    """Ids of a word as packed integers: bounded memory of the automaton's and the merged answers."""

    def __init__(self, name: str, path: str):
        super().__init__()
        self.fsa, self.path = automaton(name), path
        _, self.ranks, self.special = vocab.load(path)

    def learn(self, words) -> None:
        if len(self) > CACHE:
            self.clear()
        new = [w for w in words if w not in self]
        raw = [w.encode() for w in new]
        at = self.fsa.find(raw)
        known, rest = np.nonzero(at >= 0)[0], np.nonzero(at < 0)[0].tolist()
        self.update(zip((new[k] for k in known.tolist()), self.fsa.packed(at[known])))
        short = [k for k in rest if len(raw[k]) <= LONG]
        self.update(zip((new[k] for k in short), merge_many([raw[k] for k in short], self.path)))
        for k in rest:
            if len(raw[k]) > LONG:
                ids = merge(raw[k], self.ranks)
                self[new[k]] = pack(f"<{len(ids)}i", *ids)
        if vocab.SPECIAL in self:
            self[vocab.SPECIAL] = pack("<i", self.special)


def encode(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text", path: str = None) -> DataFrame:
    """(key, ids array<int>) of every whole text, by the lexicon file ``name``."""
    path = path or vocab.default_path()
    rows = docs.select(F.col(key), whole_text(text).alias("_text"))

    def run(batches):
        words = None
        for batch in batches:
            words = words if words is not None else Words(name, path)
            pieces = [_pieces(t) for t in batch.column(1).to_pylist()]
            words.learn(set(chain.from_iterable(pieces)))
            ids = [b"".join(map(words.__getitem__, p)) for p in pieces]
            bounds = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=[key, "ids"])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ids: str = "ids", to: str = "text", path: str = None) -> DataFrame:
    """Adds the text of an id list; bytes that are not UTF-8 become U+FFFD, a null list the empty text."""
    path = path or vocab.default_path()

    @F.arrow_udf(T.StringType())
    def texts(lists: pa.Array) -> pa.Array:
        blob, begin, size = byte_table(path)
        lists = lists.fill_null([]) if lists.null_count else lists
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        out = []
        for a, b in zip(bounds, bounds[1:]):
            own = flat[a:b]
            n = size[own]
            at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(blob[at].tobytes().decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return encoded.withColumn(to, texts(F.col(ids)))


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, with the start and length of each id."""
    table, _, _ = vocab.load(path)
    size = np.fromiter(map(len, table), np.int64, len(table))
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size
