"""Problem 7: documents into containers of fixed capacity, each whole in one container.

Lexical retrieval packing: documents are routed to shards by their words, so
that related ones meet.  Centroids of hashed words are fitted on a bounded
sample and put in a chain of neighbours; a document's place is its centroid's
stretch of the chain and, in it, a hash; shards are equal pieces of the chain.
Each shard is one partition and has a BM25 inverted index; the largest unused
document seeds a container, and its best-scoring unused neighbours that still
fit fill it, the tightest fit closing it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.tokens import TOKENIZER, Tokens, tokens

CAPACITY = 2048
#: Documents of a shard on average; a task holds the index of twice as many, or of so many characters, at most.
SHARD_DOCS, SHARD_CHARS = 4096, 64_000_000
#: Documents the centroids are fitted on, centroids, and classes of words.
FIT_DOCS, CENTROIDS, CLASSES = 2_000, 64, 512
#: BM25.
K1, B = 1.2, 0.75
#: The room at and under which the tightest fit is taken instead of the next neighbour, as a share of the capacity.
CLOSE = 0.25

_FIELDS = [("container", pa.int64()), ("doc_id", pa.int64()), ("segment", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int32()), ("place", pa.int32()), ("score", pa.float64())]
SCHEMA = "container bigint, doc_id bigint, segment int, start_token bigint, n_tokens int, place int, score double"


class _Terms(dict):
    """Term of a blank-separated part: its letters and digits in small letters, '' if it has none."""

    def __missing__(self, part: str) -> str:
        t = re.sub(r"[\W_]+", "", part.lower())
        if len(self) >= 400_000:
            self.clear()
        if len(part) <= 48:
            self[part] = t
        return t


_terms = _Terms()


def terms_of(parts: list[str]) -> Counter:
    """Bag of the terms of a text's parts."""
    bag = Counter(map(_terms.__getitem__, parts))
    bag.pop("", None)
    return bag


class _Classes(dict):
    """Hash class of the term of a blank-separated part, -1 for numbers and what has no term."""

    def __missing__(self, part: str) -> int:
        t = _terms[part]
        c = zlib.crc32(t.encode()) % CLASSES if t and not t[0].isdigit() else -1
        if len(self) >= 400_000:
            self.clear()
        if len(part) <= 48:
            self[part] = c
        return c


_classes = _Classes()


def features(texts: list[str]) -> np.ndarray:
    """Log counts of words by hash class, a row a text."""
    out = np.zeros((len(texts), CLASSES))
    for i, text in enumerate(texts):
        n = Counter(map(_classes.__getitem__, text.split(" ")))
        n.pop(-1, None)
        out[i, list(n)] = 1 + np.log(np.fromiter(n.values(), np.float64, len(n)))
    return out


class Router:
    """Centroids in a chain, with the share of the documents before and in each."""

    def __init__(self, sample: np.ndarray, seed: int = 42) -> None:
        self.idf = np.log((1 + len(sample)) / (1 + (sample > 0).sum(0)))
        x = self._unit(sample * self.idf)
        k = max(1, min(CENTROIDS, len(x) // 8))
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), k, replace=False)] if len(x) else np.zeros((1, CLASSES))
        for _ in range(12 if len(x) else 0):
            near = (x @ c.T).argmax(1)
            c = self._unit(np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)]))
        chain = [int((c @ c.mean(0)).argmin())]
        while len(chain) < k:  # the next one is the nearest not yet in the chain
            last = c @ c[chain[-1]]
            last[chain] = -np.inf
            chain.append(int(last.argmax()))
        self.centroids = c[chain]
        n = np.bincount((x @ self.centroids.T).argmax(1), minlength=k) + 0.5 if len(x) else np.ones(1)
        self.share = n / n.sum()
        self.before = np.concatenate([[0.0], np.cumsum(self.share)[:-1]])

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def places(self, texts: list[str], salts: np.ndarray) -> np.ndarray:
        """Place of each text in the chain, 0 to 1; salts in [0, 1) spread the texts of one centroid over its stretch."""
        near = [(self._unit(features(texts[a : a + 512]) * self.idf) @ self.centroids.T).argmax(1) for a in range(0, len(texts), 512)]
        at = np.concatenate([*near, np.zeros(0, np.int64)])
        return self.before[at] + salts * self.share[at]


class Index:
    """BM25 inverted index of one shard."""

    def __init__(self, bags: list[Counter]) -> None:
        n = len(bags)
        vocab: dict[str, int] = {}
        sizes = np.fromiter(map(len, bags), np.int64, n)
        term = np.fromiter((vocab.setdefault(w, len(vocab)) for b in bags for w in b), np.int64, int(sizes.sum()))
        tf = np.fromiter((c for b in bags for c in b.values()), np.float64, len(term))
        doc = np.repeat(np.arange(n), sizes)
        df = np.bincount(term, minlength=len(vocab))
        idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))  # words of half the shard and more weigh nothing
        length = np.bincount(doc, weights=tf, minlength=n)
        norm = K1 * (1 - B + B * length / max(length.mean(), 1.0)) if n else length
        keep = (idf[term] > 0) & (df[term] > 1)  # a word of one document retrieves no other
        term, tf, doc = term[keep], tf[keep], doc[keep]
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.n = n
        self.by_doc = np.searchsorted(doc, np.arange(n + 1))
        self.terms = term
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(len(vocab) + 1))

    def drop(self, keep: np.ndarray) -> None:
        """Takes the postings of documents out that are no longer asked for; the others' weights stay."""
        stay = keep[self.post_doc]
        before = np.concatenate(([0], np.cumsum(stay)))
        self.start = before[self.start]
        self.post_doc, self.post_weight = self.post_doc[stay], self.post_weight[stay]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document of the shard for the words of one."""
        t = self.terms[self.by_doc[doc] : self.by_doc[doc + 1]]
        a, k = self.start[t], self.start[t + 1] - self.start[t]
        total = int(k.sum())
        if not total:
            return np.zeros(self.n)
        at = np.repeat(a - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(total)
        return np.bincount(self.post_doc[at], weights=self.post_weight[at], minlength=self.n)


def fill(sizes: np.ndarray, index: Index, capacity: int = CAPACITY) -> list[list[tuple[int, float]]]:
    """Containers as lists of (item, score against the seed); sizes are 1 to ``capacity``."""
    unused = sizes > 0
    out = []
    indexed = len(sizes)
    for seed in np.argsort(-sizes, kind="stable"):
        if not unused[seed]:
            continue
        if (left := int(unused.sum())) < 0.8 * indexed:
            index.drop(unused)
            indexed = left
        unused[seed] = False
        box, room = [(int(seed), 0.0)], capacity - int(sizes[seed])
        can = np.flatnonzero(unused & (sizes <= room))
        if len(can):
            score = index.scores(int(seed))[can]
            size = sizes[can]
            while len(can):
                # far from full: the best neighbour; nearly full, or after the last neighbour: the tightest fit, the better score first
                if room > CLOSE * capacity and score.max() > 0:
                    i = int(score.argmax())
                else:
                    top = size.max()
                    i = int(np.where(size == top, score, -1.0).argmax())
                box.append((int(can[i]), float(score[i])))
                unused[can[i]] = False
                room -= int(size[i])
                left = size <= room
                left[i] = False
                can, score, size = can[left], score[left], size[left]
        out.append(box)
    return out


def _pack_shard(ids: list, texts: list[str], t: Tokens, capacity: int) -> pa.RecordBatch:
    rows: list[tuple] = []
    bags, sizes, items = [], [], []
    for doc, text in zip(ids, texts):
        parts = t.parts(text)
        n = t.count_parts(parts)
        whole, rest = divmod(n, capacity)
        if n > capacity:  # longer than a container: full windows, and what is left is packed
            rows += [(None, doc, i, i * capacity, capacity, 0, 0.0) for i in range(whole)]
        elif n == capacity:
            whole, rest = 0, n
        if rest:
            bags.append(terms_of(parts))
            sizes.append(rest)
            items.append((doc, whole, whole * capacity, rest))
    boxes = [[r] for r in rows]
    for box in fill(np.array(sizes, dtype=np.int64), Index(bags), capacity):
        boxes.append([(None, *items[i], place, s) for place, (i, s) in enumerate(box)])
    flat = [r for b in boxes for r in b]
    number = [k for k, b in enumerate(boxes) for _ in b]
    cols = [number, *list(zip(*flat))[1:]] if flat else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, (_, ty) in zip(cols, _FIELDS)], names=[n for n, _ in _FIELDS])


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """(container, doc_id, segment, start_token, n_tokens, place, score): what lies in each container.

    A document of at most ``capacity`` tokens is one row; a longer one fills
    containers of its own with windows of ``capacity`` tokens, segment by
    segment, and its rest is packed like a document.  score is the BM25 of the
    neighbour against the container's seed (0 for the seed).  container is a
    number unique over the input.  NULL and empty texts have no tokens and no
    row; copies of a text are documents like others; repeated doc_ids are
    packed each; further columns are ignored; an empty table gives no rows.
    The centroids are fitted on about FIT_DOCS documents in hash order; all
    documents are routed, and moved once.
    """
    d = docs.where("text <> ''").select(F.col("doc_id").cast("bigint"), "text")
    n = max(docs.count(), 1)
    salt = F.shiftrightunsigned(F.xxhash64("doc_id", F.length("text")), 1) / F.lit(float(2**63))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(features(b.column(0).to_pylist()).tolist(), pa.list_(pa.float64()))], names=["v"])

    sample = d.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, FIT_DOCS / n))).select("text").mapInArrow(vectors, "v array<double>")
    fitted = sorted(r["v"] for r in sample.limit(4 * FIT_DOCS).collect())  # in an order of its own, so the fit is the same on every run
    router = Router(np.array(fitted) if fitted else np.zeros((0, CLASSES)))
    shards = -(-n // SHARD_DOCS)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = router.places(b.column(1).to_pylist(), b.column(2).to_numpy())
                shard = np.minimum((at * shards).astype(np.int32), shards - 1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shard)], names=["doc_id", "text", "shard"])

    routed = d.withColumn("salt", salt).mapInArrow(route, "doc_id bigint, text string, shard int").repartitionById(shards, "shard").sortWithinPartitions("doc_id", "text").drop("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = tokens(path)
        part = TaskContext.get().partitionId()
        base = part << 36
        ids: list = []
        texts: list[str] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, chars
            got = _pack_shard(ids, texts, t, capacity)
            n = got.column(0).to_numpy() + base
            base = int(n.max()) + 1 if len(n) else base
            ids.clear()
            texts.clear()
            chars = 0
            return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), *got.columns[1:]], names=got.schema.names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text)
                chars += len(text)
                if len(ids) >= 2 * SHARD_DOCS or chars >= SHARD_CHARS:
                    yield flush()
        if ids:
            yield flush()

    return routed.mapInArrow(run, SCHEMA)


def usage(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: (n_containers, n_tokens, used): the share of the room that holds tokens."""
    box = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return box.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.round(F.sum("n") / (F.count("*") * F.lit(capacity)), 6).alias("used"))
