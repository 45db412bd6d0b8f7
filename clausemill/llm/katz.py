"""Language-model scoring by a Katz backoff model of ``ORDER`` words (trigrams).

Counts of the training documents are discounted by Good-Turing at every order. A context's left mass goes to
the words not seen after it in proportion to their probability at the next lower order (exactly normalised: the
weight is the left mass over one minus the lower-order probability of the words seen), and the unigrams' left
mass is that of all unknown words together. A token is scored recursively: by its n-gram if that was seen, else
by its context's backoff weight times its score at the next lower order. A text's first words have a start mark
as context.

The counts are tables partitioned by hash: a bucket owns words, or contexts with all that follows them. A word's
id is its place in its bucket, so equal ids are equal words. A context that is frequent is dealt over
several buckets by the next word, and all of these are asked for their parts of its total. Documents are packed
into chunks, kept in the shared folder in buckets by chunk, so they are never shuffled; order by order each
chunk asks the owners once for its distinct n-grams and learns what the next order needs (see :mod:`blobs`).
Nothing but a dozen totals an order reaches the driver. :func:`fit` writes the tables as Parquet, partitioned by order,
and :func:`score` with that model scores any other corpus: a model's row enters its bucket as one more message.

Defined cases: a null or empty text has its end token only; a very long text is one chunk; a null id trains;
repeated rows count and are scored each; ties don't arise; extra columns are left out; an empty table gives an
empty result; without training tokens a known word doesn't exist and every token is unknown, with
probability one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.llm import blobs, common

FOLDS = 5
ORDER = 3
#: Counts above this aren't discounted.
TRUSTED = 5
#: Tokens of a chunk (about), and training tokens of a bucket (on average), at least; tokens of an input split at most (about).
CHUNK, BUCKET, SPLIT = 5 << 18, 1 << 20, 1 << 25
#: Bytes of a word beyond which it isn't handled together with others.
LONG = 1 << 10
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The id of the mark before a text; words have ids from 1.
START = 0
END = b""
MODEL = -1


class Words(dict):
    """Number of each word, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of a text and its end."""
    return [*(text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(), END]


def held(doc_id: object, folds: int = FOLDS) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 1


def discounts(n: np.ndarray, trusted: int = TRUSTED) -> np.ndarray:
    """Discount of counts 0 to ``trusted`` + 1 (the last: any higher count), from n[r] = events seen r times.

    Good-Turing as Katz limits it to small counts; where the counts of counts allow no
    discount between 0 and 1, an absolute one stands in.
    """
    out = np.ones(trusted + 2)
    out[0] = 0.0
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] > 0 else 0.5
    common_ = (trusted + 1) * n[trusted + 1] / n[1] if n[1] > 0 else 1.0
    for r in range(1, trusted + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common_) / (1 - common_) if n[r] > 0 and common_ < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - min(max(absolute, 0.05), 0.95)) / r
    return out


@dataclass(frozen=True)
class Unigrams:
    """Totals of the training tokens: all, distinct, and the discount of small counts."""

    total: int
    distinct: int
    discount: tuple[float, ...]
    left: float

    @staticmethod
    def of(total: int, distinct: int, n: np.ndarray) -> Unigrams:
        d = discounts(n)
        r = np.arange(TRUSTED + 1)
        if not total:
            return Unigrams(0, 0, tuple(d), 1.0)
        left = float(((1 - d[: TRUSTED + 1]) * r * n[: TRUSTED + 1]).sum() / total)
        return Unigrams(total, distinct, tuple(d), left)

    def probability(self, c: np.ndarray) -> np.ndarray:
        """Of words with these counts; 0 stands for all unknown words together.

        Without a singleton nothing would be left to unknown words: the total is then taken one larger.
        """
        total, left = (self.total, self.left) if self.left > 0 else (self.total + 1, 1 / (self.total + 1))
        known = np.array(self.discount)[np.minimum(c, TRUSTED + 1)] * c / max(total, 1)
        return np.where(c > 0, known, left)


@dataclass(frozen=True)
class Plan:
    """What all chunks and buckets know: number of buckets, tokens of a bucket, whether the documents are learned from and the model is
    to be saved, the unigrams and the discounts of orders 2 and up, as far as these are counted."""

    n: int
    most: int
    learn: bool
    save: bool = False
    unigrams: Unigrams | None = None
    discount: tuple[tuple[float, ...], ...] = ()


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of whole numbers from 0, and them in that order. Numbers with their places beside them, if both fit, are sorted faster than places by numbers."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()) < 2 ** (63 - bits):
        packed = key.astype(np.int64) << bits
        packed |= np.arange(len(key))
        packed.sort()
        return packed & ((1 << bits) - 1), packed >> bits
    order = np.argsort(key)
    return order, key[order]


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value of ``key``, ascending, and each row's number among the values."""
    order, key = _sorted(key)
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    where = np.empty(len(key), np.int64)
    where[order] = new.cumsum() - 1
    return order[new], where


def _joint(arrays: Iterable[np.ndarray]) -> np.ndarray:
    """One number for each row of several columns of whole numbers; equal for equal rows only."""
    out = None
    for a in arrays:
        a = a.astype(np.int64)
        if out is None:
            out = a
            continue
        if len(a) and (int(out.max()) + 1) * (int(a.max()) + 1) >= 2**62:
            out, a = _distinct(out)[1], _distinct(a)[1]
        out = out * (int(a.max()) + 1 if len(a) else 1) + a
    return out


def _bucket(ids: list[np.ndarray], salt: np.ndarray | int, n: int) -> np.ndarray:
    """Owner of each context, whose words are the columns ``ids``."""
    with np.errstate(over="ignore"):
        h = np.full(len(ids[0]), salt, np.uint64) if np.isscalar(salt) else salt.astype(np.uint64)
        for x in ids:
            h = (h ^ (x.astype(np.uint64) + _MORE)) * _MIX
            h ^= h >> np.uint64(29)
        return ((h * _MORE >> np.uint64(24)) % np.uint64(n)).astype(np.int64)


def _salt(word: np.ndarray, salts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((word.astype(np.uint64) * _MIX) >> np.uint64(32)) % salts.astype(np.uint64)


def _owners(lens: np.ndarray, body: np.ndarray, n: int) -> np.ndarray:
    """Owner of each word, by a polynomial of its bytes or, if it is long, a digest; words as :func:`_pack_words` has them."""
    from xxhash import xxh64_intdigest

    lens = lens.astype(np.int64)
    ends, h = lens.cumsum(), np.empty(len(lens), np.uint64)
    with np.errstate(over="ignore"):
        power = np.full(LONG, _MIX).cumprod(dtype=np.uint64)
        short = np.where(lens > LONG, 0, lens)
        for i in range(0, len(lens), 1 << 16):  # what stands beside the bytes is eight times as large
            j = slice(i, i + (1 << 16))
            at = np.arange(short[j].sum()) - np.repeat(short[j].cumsum() - short[j], short[j])
            x = (body[at + np.repeat((ends - lens)[j], short[j])] + _MORE) * power[at]
            sums = np.append(np.uint64(0), x.cumsum(dtype=np.uint64))
            h[j] = sums[short[j].cumsum()] - sums[short[j].cumsum() - short[j]]
        for i in np.nonzero(lens > LONG)[0]:
            h[i] = xxh64_intdigest(body[ends[i] - lens[i] : ends[i]].tobytes())
        h = (h ^ (h >> np.uint64(32))) * _MORE
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return ((h >> np.uint64(24)) % np.uint64(n)).astype(np.int64)


def _reordered(lens: np.ndarray, body: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed words in another order."""
    if len(lens) and int(lens.max()) > LONG:
        words = _unpack_words(lens, body)
        return lens[order], np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
    lens = lens.astype(np.int64)
    own, start = lens[order], (lens.cumsum() - lens)[order]
    return own, body[np.arange(own.sum()) + np.repeat(start - (own.cumsum() - own), own)]


def _pack_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return blobs.small(np.array([len(w) for w in words], np.int64)), np.frombuffer(b"".join(words), np.uint8)


def _unpack_words(lens: np.ndarray, body: np.ndarray) -> list[bytes]:
    raw, ends = body.tobytes(), lens.astype(np.int64).cumsum().tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def chunks(docs: DataFrame, most: int, learn: bool) -> DataFrame:
    """Rows of chunks: documents (ids, held, lengths), and their tokens as ranks in the chunk's list of words."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number, ids, parts, size, words = TaskContext.get().partitionId() << 32, [], [], 0, Words()
        id_arrow = None

        def chunk():
            at = np.concatenate(parts)
            order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            lens = np.array([len(p) for p in parts])
            listed = list(words)
            data = blobs.pack(blobs.small(lens), np.array([not learn or held(i) for i in ids], np.uint8), *_pack_words([listed[i] for i in order]), blobs.small(rank[at]))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([ids], pa.list_(id_arrow)), pa.array([data], pa.binary())], names=["to", "n", "ids", "data"]
            )

        for b in batches:
            id_arrow = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                parts.append(np.array(list(map(words.__getitem__, tokens(text))), np.int32))
                size += len(parts[-1])
                if size >= most:
                    yield chunk()
                    number, ids, parts, size, words = number + 1, [], [], 0, Words()
        if ids:
            yield chunk()

    return common.arrow(docs.select("doc_id", "text"), run, f"`to` long, n long, ids array<{id_type}>, data binary")


def _load(data: bytes) -> tuple:
    lens, held_, word_lens, body, at = blobs.unpack(data)
    lens = lens.astype(np.int64)
    return lens, held_, (word_lens, body), at.astype(np.int64), np.repeat(held_ == 0, lens)


def _ask_words(chunk: int, own: dict, n: int) -> Iterable[tuple]:
    _, _, words, at, train = _load(own["data"])
    counts, bucket = np.bincount(at[train], minlength=len(words[0])), _owners(*words, n)
    order = np.argsort(bucket, kind="stable")
    lens, body = _reordered(*words, order)
    edges, ends = np.concatenate(([0], np.bincount(bucket, minlength=n).cumsum())), np.concatenate(([0], lens.cumsum(dtype=np.int64)))
    for b in np.unique(bucket):
        x, y = edges[b], edges[b + 1]
        yield int(b), chunk, "ask", blobs.pack(blobs.small(lens[x:y]), body[ends[x] : ends[y]], blobs.small(counts[order[x:y]]))


def _answer_words(bucket: int, got: list, p: Plan) -> Iterable[tuple]:
    """For each chunk its words' ids and counts; the training words as a row of the model."""
    ids, parts = Words(), []
    for _, _, data in got:
        lens, body, counts = blobs.unpack(data)
        parts.append((np.array([ids[w] for w in _unpack_words(lens, body)], np.int64), counts.astype(np.int64)))
    counts = np.zeros(len(ids), np.int64)
    for at, c in parts:
        np.add.at(counts, at, c)
    # Frequent words get small numbers, which pack well; words of the model keep their places when others come.
    order = np.argsort(-counts if p.learn else counts == 0, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    yield -1, bucket, "totals", _tally(counts)
    if p.save and (counts > 0).any():
        listed = list(ids)
        known = order[: (counts > 0).sum()]
        yield bucket, MODEL, "model", blobs.pack(*_pack_words([listed[i] for i in known]), blobs.small(counts[known]))
    for (chunk, _, _), (at, _) in zip(got, parts, strict=True):
        if chunk != MODEL:
            yield chunk, bucket, "1", blobs.pack(blobs.small(1 + place[at] * p.n + bucket), blobs.small(counts[at]))


def _tally(counts: np.ndarray) -> bytes:
    n = np.bincount(np.minimum(counts, TRUSTED + 2), minlength=TRUSTED + 3)
    return blobs.pack(np.concatenate(([counts.sum(), (counts > 0).sum()], n)).astype(np.int64))


def _totals(answers: DataFrame) -> np.ndarray:
    """Sum of the totals of all buckets: a row of a dozen numbers from each, summed by Spark."""
    n = 2 + TRUSTED + 3

    def read(data: list) -> Iterable:
        x = np.array([blobs.unpack(bytes(d))[0] for d in data], np.int64).reshape(-1, n).sum(0)
        return [[int(v)] for v in x]

    sums = common.map_rows(answers.where(blobs.of("totals")), ["data"], read, ", ".join(f"t{i} long" for i in range(n)), rows=None)
    return np.array([x or 0 for x in sums.agg(*[F.sum(f"t{i}") for i in range(n)]).first()], np.int64)


class Chunk:
    """A chunk's distinct n-grams, order by order, with what the buckets have answered so far.

    Of the current order: ``where`` (the n-gram of each token), ``context`` and ``word`` of each n-gram, the
    ``low`` n-gram of one order less, ``ids`` (the words of each context from the last to the first, a column each), ``seen`` (how often a
    context was seen) and ``low_size`` (events of the context of one order less). A context is an n-gram of the
    order before, or, as the last one, the start of a text.
    """

    def __init__(self, own: dict, got: list, p: Plan) -> None:
        self.p, self.got = p, {(kind, b): data for b, kind, data in got}
        self.lens, self.held, words, self.at, self.train = _load(own["data"])
        self.n_words = len(words[0])
        self.starts = np.concatenate(([0], self.lens.cumsum()[:-1]))
        bucket = _owners(*words, p.n)
        self.word_ids, self.c = np.zeros(self.n_words, np.int64), np.zeros(self.n_words, np.int64)
        for b in np.unique(bucket):
            ids, c = blobs.unpack(self.got["1", int(b)])
            mine = bucket == b
            self.word_ids[mine], self.c[mine] = ids, c
        self.order, self.counts = 1, self.c
        self.texts = int(self.c[words[0] == len(END)][0])  # training texts: each has one end, the only empty word
        self.where = self.word = self.at
        self.log = np.log10(p.unigrams.probability(self.c))
        self.ids: list[np.ndarray] = []
        self.size = np.zeros(1)
        self.context = np.zeros(self.n_words, np.int64)
        self.word = np.arange(self.n_words)
        for k in range(2, 2 + len(p.discount)):
            self.extend()
            self.learn(k)

    def extend(self) -> None:
        """To the next order."""
        n = len(self.word)
        before = np.empty_like(self.where)
        before[1:] = self.where[:-1]
        before[self.starts] = n
        low_context = self.context[self.where] if self.order > 1 else None
        self.ids = [np.append(self.word_ids[self.word], START)] + [np.append(x[self.context], START) for x in self.ids]
        self.seen = np.append(self.c, self.texts)
        first, where = _distinct(before * self.n_words + self.at)
        self.low_size = np.zeros(n + 1)
        if low_context is not None:
            self.low_size[before[first]] = self.size[low_context[first]]
        self.low, self.low_c = self.where[first], self.c[self.where[first]]
        self.context, self.word, self.where = before[first], self.at[first], where
        self.order += 1

    def parts(self) -> Iterable[tuple]:
        """What the chunk asks of each bucket: the bucket, the n-grams (by context), the contexts, the place of each n-gram's context.

        A context that is dealt is asked of all its buckets, also where the chunk has no n-gram of it, as each
        has a part of its total. Those are no more than eight contexts a bucket on average and order.
        """
        n, m = self.p.n, len(self.seen)
        by = _sorted(_joint(self.ids))[0]  # contexts by the ids of their words, which packs well
        rank = np.empty(m, np.int64)
        rank[by] = np.arange(m)
        self.salts = self.seen // max(self.p.most // 4, 1) + 1
        known = np.nonzero(self.seen[self.context] > 0)[0]  # after a context that was never seen nothing was: the lower order decides
        context, word = self.context[known], self.word[known]
        bucket = _bucket([x[context] for x in self.ids], _salt(self.word_ids[word], self.salts[context]), n)
        order = known[_sorted(_joint((bucket, rank[context], word)))[0]]
        edges = np.concatenate(([0], np.bincount(bucket, minlength=n).cumsum()))
        dealt = np.unique(context[self.salts[context] > 1])
        times = self.salts[dealt]
        owner = np.repeat(dealt, times)
        salt = np.arange(len(owner)) - np.repeat(times.cumsum() - times, times)
        more = np.unique(_bucket([x[owner] for x in self.ids], salt, n) * m + rank[owner])
        more_edges = np.searchsorted(more // m, np.arange(n + 1))
        for b in np.nonzero(np.diff(edges) + np.diff(more_edges))[0]:
            mine = order[edges[b] : edges[b + 1]]
            r, asked = rank[self.context[mine]], more[more_edges[b] : more_edges[b + 1]] % m
            if len(asked):
                own = np.union1d(r, asked)
                yield int(b), mine, by[own], np.searchsorted(own, r)
            else:
                new = np.concatenate(([True], r[1:] != r[:-1]))
                yield int(b), mine, by[r[new]], new.cumsum() - 1

    def ask(self, chunk: int) -> Iterable[tuple]:
        local = np.bincount(self.where[self.train], minlength=len(self.word))
        for b, mine, own, place in self.parts():
            ids = [x[own] for x in self.ids]
            yield b, chunk, "ask", blobs.pack(
                blobs.small(np.diff(ids[0], prepend=0)), *map(blobs.small, ids[1:]), blobs.small(np.bincount(place, minlength=len(own))),
                (self.salts[own] > 1).view(np.uint8), blobs.small(self.low_size[own].astype(np.int64)),
                blobs.small(self.word_ids[self.word[mine]]), blobs.small(local[mine]), blobs.small(self.low_c[mine]),
            )

    def learn(self, k: int) -> None:
        """Counts and log probabilities of the n-grams from the buckets' answers."""
        m = len(self.seen)
        c = np.zeros(len(self.word), np.int64)
        total, lost, mass = np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
        d, r = np.array(self.p.discount[k - 2]), np.arange(1, TRUSTED + 1)
        taken = (1 - d[1 : TRUSTED + 1]) * r  # from each small count of a context
        for b, mine, own, place in self.parts():
            x = blobs.unpack(self.got[str(k), b])
            c[mine] = x[0]
            total[own] += x[1].astype(np.int64)
            lost[own] += taken @ np.array(x[2 : 2 + TRUSTED])
            mass[own[_weighed(x[0], place, self.salts[own] > 1)]] += x[-1]
        self.size = np.where((lost <= 0) & (total > 0), total + 1, total).astype(np.float64)  # a context without one gives one event
        left = np.where(lost > 0, lost, 1.0) / np.maximum(self.size, 1)
        weight = np.where(total > 0, left / (1 - np.minimum(mass, 1 - 1e-15)), 1.0)
        seen = d[np.minimum(c, TRUSTED + 1)] * c / np.maximum(self.size[self.context], 1)
        self.log = np.log10(np.where(c > 0, seen, weight[self.context])) + np.where(c > 0, 0.0, self.log[self.low])
        self.c = c


def _weighed(counts: np.ndarray, context: np.ndarray, dealt: np.ndarray) -> np.ndarray:
    """Contexts with an n-gram that was never seen; and those dealt over several buckets, as each has a part of the mass."""
    return (np.bincount(context[counts == 0], minlength=len(dealt)) > 0) | dealt


def _ask(chunk: int, own: dict, got: list, p: Plan) -> Iterable[tuple]:
    c = Chunk(own, got, p)
    c.extend()
    return c.ask(chunk)


def _answer(bucket: int, got: list, p: Plan, k: int) -> Iterable[tuple]:
    """For each chunk, of its n-grams: their counts; of its contexts here: total and how many followers have a count of 1 to
    TRUSTED; of those that need a backoff weight (see :func:`_weighed`), the followers' mass at the next lower order."""
    parts = [blobs.unpack(d) for _, _, d in got]
    join = lambda i: np.concatenate([x[i] for x in parts])
    ids = [np.concatenate([x[0].astype(np.int64).cumsum() for x in parts]), *(join(i).astype(np.int64) for i in range(1, k - 1))]
    first_owner, owner = _distinct(_joint(ids))
    n = len(first_owner)
    context = np.repeat(owner, join(k - 1).astype(np.int64))
    low_size = join(k + 1).astype(np.float64)[first_owner]
    word = join(k + 2).astype(np.int64)
    first, at = _distinct(_joint((context, word)))
    counts = np.bincount(at, join(k + 3).astype(np.float64), len(first)).astype(np.int64)
    low_c = join(k + 4).astype(np.int64)[first]
    yield -1, bucket, "totals", _tally(counts)
    seen = counts > 0
    c, of = counts[seen], context[first][seen]
    if k == 2:
        low = p.unigrams.probability(low_c[seen])
    else:
        low = np.array(p.discount[k - 3])[np.minimum(low_c[seen], TRUSTED + 1)] * low_c[seen] / np.maximum(low_size[of], 1)
    total = np.bincount(of, c, n).astype(np.int64)
    few = [np.bincount(of[c == r], minlength=n) for r in range(1, TRUSTED + 1)]
    mass = np.bincount(of, low, n)
    if p.save and len(c):
        used = np.unique(of)
        columns = [x[first_owner][used] for x in ids]
        order = np.lexsort(columns[::-1])  # rows of the model are written as a chunk's
        rank = np.empty(n, np.int64)
        rank[used[order]] = np.arange(len(used))
        by = np.argsort(rank[of], kind="stable")
        yield bucket, MODEL, "model", blobs.pack(
            blobs.small(np.diff(columns[0][order], prepend=0)), *[blobs.small(x[order]) for x in columns[1:]], blobs.small(np.bincount(rank[of], minlength=len(used))),
            np.zeros(len(used), np.uint8), blobs.small(low_size[used[order]].astype(np.int64)),
            blobs.small(word[first][seen][by]), blobs.small(c[by]), blobs.small(low_c[seen][by]),
        )
    start = start_c = 0
    for (chunk, _, _), x in zip(got, parts, strict=True):
        n_words, n_own = len(x[k + 2]), len(x[0])
        mine, own = at[start : start + n_words], owner[start_c : start_c + n_own]
        start, start_c = start + n_words, start_c + n_own
        if chunk == MODEL:
            continue
        weighed = _weighed(counts[mine], np.repeat(np.arange(n_own), x[k - 1].astype(np.int64)), x[k] > 0)
        yield chunk, bucket, str(k), blobs.pack(blobs.small(counts[mine]), blobs.small(total[own]), *[blobs.small(f[own]) for f in few], mass[own][weighed])


def _score(_: int, own: dict, got: list, p: Plan) -> Iterable[tuple]:
    c = Chunk(own, got, p)
    uni = p.unigrams
    base = np.log10((c.counts + 0.5) / (uni.total + 0.5 * (uni.distinct + 1))) if uni.total else np.zeros(c.n_words)
    per = lambda x: np.add.reduceat(x, c.starts).tolist()
    yield from zip(own["ids"], (c.held == 1).tolist(), c.lens.tolist(), per((c.counts[c.at] > 0).astype(np.int64)), [uni.total] * len(c.lens), per(base[c.at]), per(c.log[c.where]), strict=True)


def _build(docs: DataFrame, order: int, chunk: int | None, bucket: int | None, model: DataFrame | None = None, save: bool = False) -> tuple[DataFrame, Plan, list[DataFrame]]:
    """The table of chunks, the plan with all totals, and the kept answers of the buckets for each order."""
    learn, n_splits = model is None, blobs.splits(docs)
    table = common.keep(chunks(docs, chunk or blobs.size(n_splits, CHUNK, SPLIT), learn), "katz-chunks", buckets=(2 * n_splits, "to"))
    if learn:
        most = bucket or blobs.size(n_splits, BUCKET, SPLIT)
        n = max(1, -(-(table.agg(F.sum("n")).first()[0] or 0) // most))
    else:
        n, most = model.select("owners", "most").first()
    p, answers = Plan(n, most, learn, save), []
    of_model = lambda k: model.where(F.col("order") == k).select(F.col("bucket").alias("to"), F.lit(MODEL).cast("long").alias("from"), F.lit("ask").alias("kind"), "data")
    for k in range(1, order + 1):
        if k == 1:
            asks = blobs.each(table.select("to", F.col("to").alias("from"), F.lit("chunk").alias("kind"), "data"), lambda to, got, p=p: _ask_words(to, {"data": got[0][2]}, p.n))
            answer = lambda to, got, p=p: _answer_words(to, got, p)
        else:
            asks = blobs.meet(table, _for_chunks(answers), lambda to, own, got, p=p: _ask(to, own, got, p))
            answer = lambda to, got, p=p, k=k: _answer(to, got, p, k)
        answers.append(common.keep(blobs.exchange(asks if learn else asks.union(of_model(k)), answer, n), "katz-counts"))
        t = _totals(answers[-1])
        p = replace(p, unigrams=Unigrams.of(int(t[0]), int(t[1]), t[2:])) if k == 1 else replace(p, discount=(*p.discount, tuple(discounts(t[2:]))))
    return table, p, answers


def _for_chunks(answers: list[DataFrame]) -> DataFrame:
    out = answers[0]
    for a in answers[1:]:
        out = out.union(a)
    return out.where(~F.col("kind").isin("totals", "model"))


def fit(docs: DataFrame, path: str, order: int = ORDER, chunk: int | None = None, bucket: int | None = None) -> None:
    """Write the model of the documents that aren't held out: Parquet partitioned by order, a row for each bucket."""
    with common.scratch():
        _, p, answers = _build(docs, order, chunk, bucket, save=True)
        for k, a in enumerate(answers, 1):
            rows = a.where(blobs.of("model")).select(F.col("to").alias("bucket"), F.lit(p.n).cast("long").alias("owners"), F.lit(p.most).cast("long").alias("most"), F.lit(k).alias("order"), "data")
            rows.write.partitionBy("order").mode("append" if k > 1 else "overwrite").parquet(path)


def score(docs: DataFrame, order: int = ORDER, chunk: int | None = None, bucket: int | None = None, model: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The documents that aren't held out are learned from; with ``model`` (a path of :func:`fit`, of the same order) nothing is, and all
    are held out. ``chunk`` and ``bucket`` (tokens; at least ``CHUNK`` and ``BUCKET``, more with the input) change no result.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    with common.scratch():
        table, p, answers = _build(docs, order, chunk, bucket, docs.sparkSession.read.parquet(model) if model else None)
        out = blobs.meet(
            table, _for_chunks(answers), lambda to, own, got: _score(to, own, got, p),
            f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
        return common.lasting(common.keep(out, "katz-scores"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_katz": op10_katz}
SQL: dict[str, str] = {}
