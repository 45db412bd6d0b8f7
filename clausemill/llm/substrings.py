"""Exact removal of repeated byte strings by a run-length index.

A byte is removed where a string of ``LENGTH`` bytes over it also starts earlier in the corpus.

The corpus is parsed into phrases, as builders of run-length indexes do: every window of ``LENGTH`` bytes is owned
by its smallest ``GRAM``-byte gram (by hash, leftmost), and consecutive windows with one owner are a phrase.
Equal windows have equal owners, so they meet in the bucket of that gram, and an index is needed of a bucket's phrases
only. There

1. equal phrases fall together, byte by byte; all but the first repeat as a whole;
2. of the phrases of a gram, those go on that share the bytes before or after it with another, as equal windows do;
3. these are dealt into rounds by their order in the corpus, a round as large as all before it: its phrases make a run-compressed
   Burrows-Wheeler transform with sampled run ends, the later phrases stream their matching statistics through it, and
   matches of ``LENGTH`` bytes are marked (see :mod:`runindex`). Within a round, equal windows are found by the
   ranks that the transform was sorted by.

No result rests on a hash: hashes choose a window's owner and its bucket only. A chunk first tells the buckets its grams, and
sends the phrases of grams that another phrase of the corpus has, each different one once, packed (see :mod:`blobs`). A
gram with more than ``HOT`` phrases isn't kept whole: its windows are split by their distance from the gram into
``PARTS`` ranges, and the 81 bytes or more that all windows of a range have in common are the key instead. Chunks stay
where they are; a bucket's row for a chunk holds a phrase once, so copies add a row per chunk at most.

Defined cases: a null text has no bytes; rows with the same id are ordered as stored, so of
repeated rows the first stays; a null id comes first; ids that are whole numbers are ordered as such, others as text; texts under
``LENGTH`` bytes lose nothing; a very long text is parsed in segments; ties (a window that starts twice) go to the earlier start;
extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.llm import blobs, common, runindex

LENGTH, GRAM = 100, 24
#: Distances between a window's start and its gram, and the ranges that those of a hot gram are split into.
SPAN = LENGTH - GRAM + 1
PARTS = 4
#: Bytes that every window has on one side of its gram at least.
SIDE = (LENGTH - GRAM) // 2


@dataclass(frozen=True)
class Sizes:
    """Bytes of a chunk, of a segment of a long text, of a bucket's share of the corpus and of the phrases indexed together; phrases that
    make a gram hot and phrases of a round, at most. They change no result."""

    chunk: int = 2 << 20
    segment: int = 2 << 20
    bucket: int = 20 << 20
    block: int = 4 << 20
    hot: int = 4096

    @staticmethod
    def of(splits: int) -> Sizes:
        """Chunks and buckets that grow with the root of the input (see :func:`blobs.size`)."""
        return Sizes(chunk=blobs.size(splits, 2 << 20, 1 << 28), bucket=blobs.size(splits, 20 << 20, 1 << 28))


_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MULTIPLIER = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64).cumprod())) for b in (_B, _B_INV))


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def parse(segments: list[bytes]) -> tuple[np.ndarray, ...]:
    """Phrases of some segments of text: place of the first window, number of windows, place of the gram, segment."""
    buf = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    n = len(buf)
    windows = n - LENGTH + 1
    if windows <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    powers, inverse = _powers(max(1 << 22, 1 << (n + 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), ((buf.astype(np.uint64) + np.uint64(1)) * powers[:n]).cumsum()))
        gram = _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    low, size = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64), 1
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :])
    owner = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[:windows]
    seg = np.repeat(np.arange(len(segments)), sizes)
    whole = seg[:windows] == seg[LENGTH - 1 :]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (seg[1:windows] != seg[: windows - 1]) | ~whole[:-1])) & whole
    first = np.nonzero(new)[0]
    valid = np.concatenate(([0], whole.cumsum()))
    count = valid[np.concatenate((first[1:], [windows]))] - valid[first]
    return first, count, owner[first], seg[first]


def phrases(texts: list[bytes], most: int) -> tuple[np.ndarray, ...]:
    """Phrases of the joined texts: place of the first window, number of windows, distance of the gram.

    A text longer than a segment is cut so that every window lies in one segment.
    """
    found, part, base, size, start = [], [], [], 0, 0

    def done():
        first, count, gram, seg = parse(part)
        offset = np.array(base, np.int64) - np.concatenate(([0], np.cumsum([len(x) for x in part])[:-1])).astype(np.int64)
        found.append((first + offset[seg], count, gram - first))

    for t in texts:
        for at in range(0, max(1, len(t) - LENGTH + 1), most):
            s = t[at : at + most + LENGTH - 1]
            if size and size + len(s) > most + LENGTH:
                done()
                part, base, size = [], [], 0
            part.append(s)
            base.append(start + at)
            size += len(s)
        start += len(t)
    if part:
        done()
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def chunks(docs: DataFrame, s: Sizes) -> DataFrame:
    """Rows of chunks: ids, texts of about a chunk's bytes, and their phrases."""
    id_type = dict(docs.dtypes)["doc_id"]
    number_ids = id_type in ("tinyint", "smallint", "int", "bigint")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        id_arrow = None

        def chunk():
            lens = np.array([len(t) for t in texts], np.int64)
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            keys = np.array([-(2**63) if i is None else i for i in ids], np.int64) if number_ids else np.array([b"" if i is None else b"t" + str(i).encode() for i in ids])
            first, count, gram = phrases(texts, s.segment)
            data = blobs.pack(lens, keys, np.frombuffer(body, np.uint8), blobs.small(np.diff(first, prepend=0)), count.astype(np.uint8), gram.astype(np.uint8), level=1)
            n = int(np.maximum(lens - LENGTH + 1, 0).sum())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(id_arrow)), pa.array([data], pa.binary())], names=["to", "n", "ids", "data"])

        for b in batches:
            id_arrow = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append((text or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= s.chunk:
                    yield chunk()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield chunk()

    return common.arrow(docs.select("doc_id", "text"), run, f"`to` long, n long, ids array<{id_type}>, data binary")


def _hashed(buf: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of the ``length`` bytes at each place."""
    out = np.zeros(len(at), np.uint64)
    for n in np.unique(length):
        mine = np.nonzero(length == n)[0]
        padded = np.zeros((len(mine), -(-int(n) // 8) * 8), np.uint8)
        padded[:, :n] = buf[at[mine][:, None] + np.arange(n)]
        h = np.full(len(mine), n, np.uint64)
        with np.errstate(over="ignore"):
            for column in padded.view("<u8").T:
                h = _mix(h * _MULTIPLIER ^ column)
        out[mine] = h
    return out


def _deal(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.nonzero(np.diff(edges))[0]:
        yield int(b), order[edges[b] : edges[b + 1]]


def _steps(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count."""
    total = counts.cumsum()
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


#: What a bucket says of a gram: one phrase of the corpus has it, several have, or more than a bucket should hold.
ALONE, SHARED, OFTEN = 0, 1, 2


class Chunk:
    """A chunk's texts and phrases, and its different grams with the number of phrases of each."""

    def __init__(self, own: dict) -> None:
        self.lens, self.keys, body, first, count, gram = blobs.unpack(own["data"])
        raw = zstandard.ZstdDecompressor().decompress(body.tobytes(), max_output_size=max(1, int(self.lens.sum()))) if self.lens.sum() else b""
        self.raw, self.buf = raw, np.frombuffer(raw, np.uint8)
        self.starts = np.concatenate(([0], self.lens.cumsum()[:-1])).astype(np.int64)
        self.first, self.count, self.gram = first.astype(np.int64).cumsum(), count.astype(np.int64), gram.astype(np.int64)
        h = _hashed(self.buf, self.first + self.gram, np.full(len(self.first), GRAM))
        self.grams, self.of, self.times = np.unique(h, return_inverse=True, return_counts=True)

    def choose(self, got: list, n: int) -> None:
        """The different phrases to send, by what the buckets say: place, windows, place and length of the key, in corpus order; and which
        of them every phrase with a key equals."""
        says = np.zeros(len(self.grams), np.uint8)
        by = {b: data for b, kind, data in got if kind == "grams"}
        for b, mine in _deal((self.grams % np.uint64(n)).astype(np.int64), n):
            says[mine] = blobs.unpack(by[b])[0]
        said = says[self.of]
        whole, split = np.nonzero(said == SHARED)[0], np.nonzero(said == OFTEN)[0]
        at, count = [self.first[whole]], [self.count[whole]]
        key, length = [self.first[whole] + self.gram[whole]], [np.full(len(whole), GRAM)]
        edges = np.arange(PARTS + 1) * SPAN // PARTS
        for a, b in zip(edges[:-1], edges[1:] - 1, strict=True):  # windows with the gram at a distance of a to b
            low, high = np.maximum(self.gram[split] - b, 0), np.minimum(self.gram[split] - a, self.count[split] - 1)
            some = low <= high
            mine = split[some]
            at.append(self.first[mine] + low[some])
            count.append(high[some] - low[some] + 1)
            key.append(self.first[mine] + self.gram[mine] - a)
            length.append(np.full(len(mine), LENGTH - (b - a)))
        at, count, key, length = map(np.concatenate, (at, count, key, length))
        doc = np.searchsorted(self.starts, at, "right") - 1
        while (empty := self.lens[doc] == 0).any():  # an empty text starts where the next one does
            doc[empty] -= 1
        order = np.lexsort((at, doc, self.keys[doc]))
        self.at, self.windows, self.key, self.key_length, self.doc = at[order], count[order], key[order], length[order], doc[order]
        seen: dict[bytes, int] = {}
        ends = (self.at + self.windows + LENGTH - 1).tolist()
        self.same = np.array([seen.setdefault(self.raw[a:b], i) for i, (a, b) in enumerate(zip(self.at.tolist(), ends, strict=True))], np.int64)
        self.sent = np.nonzero(self.same == np.arange(len(self.same)))[0]
        self.hash = _hashed(self.buf, self.key[self.sent], self.key_length[self.sent])

    def dealt(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """The phrases to send to each bucket, those of a key together, which packs well."""
        by_hash = np.argsort(self.hash, kind="stable")
        for b, mine in _deal((self.hash[by_hash] % np.uint64(n)).astype(np.int64), n):
            yield b, self.sent[by_hash[mine]]


def _ask_grams(chunk: int, own: dict, n: int) -> Iterable[tuple]:
    c = Chunk(own)
    for b, mine in _deal((c.grams % np.uint64(n)).astype(np.int64), n):
        yield b, chunk, "grams", blobs.pack(np.diff(c.grams[mine], prepend=np.uint64(0)), blobs.small(c.times[mine]), level=1)


def _answer_grams(bucket: int, got: list, hot: int) -> Iterable[tuple]:
    parts = [blobs.unpack(d) for _, _, d in got]
    keys = [p[0].cumsum(dtype=np.uint64) for p in parts]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([p[1] for p in parts]).astype(np.float64))
    says = np.where(total <= 1, ALONE, np.where(total > hot, OFTEN, SHARED)).astype(np.uint8)[at]
    start = 0
    for (chunk, _, _), k in zip(got, keys, strict=True):
        yield chunk, bucket, "grams", blobs.pack(says[start : start + len(k)])
        start += len(k)


def _ask_phrases(chunk: int, own: dict, got: list, n: int) -> Iterable[tuple]:
    c = Chunk(own)
    c.choose(got, n)
    for b, mine in c.dealt(n):
        windows, at = c.windows[mine], c.at[mine]
        lens = windows + LENGTH - 1
        body = c.buf[np.repeat(at, lens) + _steps(lens)]
        used, of = np.unique(c.doc[mine], return_inverse=True)
        yield b, chunk, "phrases", blobs.pack(
            blobs.small(windows), blobs.small(c.key[mine] - at), blobs.small(c.key_length[mine]), body, c.keys[used], blobs.small(used), blobs.small(of), blobs.small(at - c.starts[c.doc[mine]])
        )


def _order(got: list, parts: list[list[np.ndarray]]) -> np.ndarray:
    """The rows in corpus order: by id, chunk, number in the chunk, place."""
    key = np.concatenate([p[4][p[6]] for p in parts])
    number = np.concatenate([p[5].astype(np.int64)[p[6]] for p in parts])
    at = np.concatenate([p[7].astype(np.int64) for p in parts])
    chunk = np.repeat([c for c, _, _ in got], [len(p[7]) for p in parts])
    return np.lexsort((at, number, chunk, key))


def _answer_phrases(bucket: int, got: list, s: Sizes) -> Iterable[tuple]:
    """For each chunk's phrases, a bit for every window: whether it starts earlier in the corpus, too."""
    parts = [blobs.unpack(d) for _, _, d in got]
    windows, offset, length = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3))
    body = np.concatenate([p[3] for p in parts]).tobytes()
    ends = (windows + LENGTH - 1).cumsum()
    texts = [body[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    del body
    seen: dict[bytes, int] = {}
    of_key: dict[bytes, list[int]] = {}
    repeated = np.zeros(len(texts), bool)
    for i in _order(got, parts).tolist():
        t = texts[i]
        if seen.setdefault(t, i) != i:
            repeated[i] = True
        else:
            of_key.setdefault(t[offset[i] : offset[i] + length[i]], []).append(i)
    bits, at = np.repeat(repeated, windows), windows.cumsum() - windows
    for group in _blocks((_likely(g, texts, offset, length) for g in of_key.values() if len(g) > 1), texts, s.block):
        for i, marked in _marked(group, texts, windows, s.hot):
            bits[at[i] : at[i] + len(marked)] |= marked
    start = 0
    for (chunk, _, _), p in zip(got, parts, strict=True):
        n = int(p[0].sum(dtype=np.int64))
        yield chunk, bucket, "phrases", blobs.pack(np.packbits(bits[start : start + n]))
        start += n


def _likely(group: list[int], texts: list[bytes], offset: np.ndarray, length: np.ndarray) -> list[int]:
    """Those phrases of a gram that share ``SIDE`` bytes before it or after it with another: each window has the one or the other."""
    if length[group[0]] != GRAM:
        return group
    sides: dict[tuple[int, bytes], list[int]] = {}
    for i in group:
        t, a = texts[i], offset[i]
        if a >= SIDE:
            sides.setdefault((0, t[a - SIDE : a]), []).append(i)
        if len(t) - a - GRAM >= SIDE:
            sides.setdefault((1, t[a + GRAM : a + GRAM + SIDE]), []).append(i)
    some = {i for x in sides.values() if len(x) > 1 for i in x}
    return [i for i in group if i in some]


def _blocks(groups: Iterable[list[int]], texts: list[bytes], most: int) -> Iterator[list[list[int]]]:
    """Groups of phrases, about ``most`` bytes together; a group isn't cut."""
    block, size = [], 0
    for g in groups:
        if len(g) < 2:
            continue
        block.append(g)
        size += sum(len(texts[i]) for i in g)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _marked(groups: list[list[int]], texts: list[bytes], windows: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Phrases and which of their windows repeat one of an earlier phrase or an earlier place of the same.

    Groups are in corpus order. Round 0 indexes each group's first phrase, round k the 2^(k-1) phrases after those of the rounds before
    (``most`` at most); the phrases of later rounds are streamed through it.
    """
    which = np.array([i for g in groups for i in g])
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    rank = np.concatenate([np.arange(len(g)) for g in groups])
    doubling = max(1, most).bit_length()
    full = 1 << (doubling - 1)
    round_ = np.where(rank < full, np.ceil(np.log2(rank + 1)).astype(np.int64), doubling + (rank - full) // full)
    last = np.zeros(len(groups), np.int64)
    np.maximum.at(last, group, round_)
    for r in range(int(round_.max()) + 1):
        inside = np.nonzero((round_ == r) & ((last[group] > r) | (np.bincount(group[round_ == r], minlength=len(groups))[group] > 1)))[0]
        if not len(inside):
            continue
        index = runindex.Index([texts[i] for i in which[inside]])
        yield from _split(which[inside], windows, index.repeated(group[inside], windows[which[inside]], LENGTH))
        later = np.nonzero((round_ > r) & (last[group] > r))[0]
        if len(later):
            yield from _split(which[later], windows, index.stream([texts[i] for i in which[later]], windows[which[later]], LENGTH))


def _split(which: np.ndarray, windows: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    ends = windows[which].cumsum()
    for i, a, b in zip(which.tolist(), (ends - windows[which]).tolist(), ends.tolist(), strict=True):
        yield i, bits[a:b]


def _removed(_: int, own: dict, got: list, n: int, texts: bool) -> Iterable[tuple]:
    c = Chunk(own)
    c.choose(got, n)
    by = {b: data for b, kind, data in got if kind == "phrases"}
    gone = np.zeros(len(c.buf) + 1, np.int64)

    def remove(at: np.ndarray, length: int | np.ndarray) -> None:
        np.add.at(gone, at, 1)
        np.subtract.at(gone, at + length, 1)

    for b, mine in c.dealt(n):
        windows = c.windows[mine]
        bits = np.unpackbits(blobs.unpack(by[b])[0], count=int(windows.sum())).astype(bool)
        remove((np.repeat(c.at[mine], windows) + _steps(windows))[bits], LENGTH)
    again = np.nonzero(c.same != np.arange(len(c.same)))[0]
    remove(c.at[again], c.windows[again] + LENGTH - 1)
    gone = gone.cumsum() > 0
    for doc_id, a, size in zip(own["ids"], c.starts.tolist(), c.lens.tolist(), strict=True):
        mine = gone[a : a + size]
        if mine.any():
            edge = np.diff(np.concatenate(([0], mine.view(np.int8), [0])))
            spans = np.column_stack((np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0])).tolist()
            rest = c.buf[a : a + size][~mine].tobytes()
        else:
            spans, rest = [], c.raw[a : a + size]
        yield doc_id, size, spans, hashlib.sha256(rest).hexdigest(), rest if texts else None


def repeats(docs: DataFrame, texts: bool = False, sizes: Sizes | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte runs), kept_sha256 and, if asked for, the kept bytes of every document."""
    splits = blobs.splits(docs)
    s = sizes or Sizes.of(splits)
    with common.scratch():
        table = common.keep(chunks(docs, s), "substrings", buckets=(splits, "to"))
        n = max(1, -(-(table.agg(F.sum("n")).first()[0] or 0) // s.bucket))
        rows = table.select("to", F.col("to").alias("from"), F.lit("chunk").alias("kind"), "data")
        asked = blobs.each(rows, lambda to, got: _ask_grams(to, {"data": got[0][2]}, n))
        grams = common.keep(blobs.exchange(asked, lambda to, got: _answer_grams(to, got, s.hot), n), "grams")
        asked = blobs.meet(table, grams, lambda to, own, got: _ask_phrases(to, own, got, n))
        marked = common.keep(blobs.exchange(asked, lambda to, got: _answer_phrases(to, got, s), n), "phrases")
        id_type = dict(docs.dtypes)["doc_id"]
        out = blobs.meet(
            table, grams.union(marked), lambda to, own, got: _removed(to, own, got, n, texts), f"doc_id {id_type}, n_bytes long, spans array<array<long>>, kept_sha256 string, kept binary"
        )
        return common.lasting(common.keep(out if texts else out.drop("kept"), "repeats"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def repeats_sql(docs: str = "documents") -> str:
    """The digest in DuckDB, over all windows of all documents (ids without repeats or nulls)."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM {docs}),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, h, unnest(range(0, n - {LENGTH - 1})) AS p FROM d WHERE n >= {LENGTH})),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
starts AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM repeated),
runs AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM starts) GROUP BY doc_id, g),
gaps AS (SELECT r.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS before, h FROM runs r JOIN d ON d.doc_id = r.doc_id),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gaps GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id"""


QUERIES = {"op8_substrings": op8_substrings}
SQL = {"op8_substrings": repeats_sql()}
